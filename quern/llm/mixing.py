"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash; a source takes the rows below a threshold. To find it, sizes are summed by source and hash bucket
(4,096 buckets), a running sum over the buckets finds the one where the budget ends, and only that boundary bucket is
split into 4,096 again, twice, which leaves single rows. Rows are then filtered by comparing hashes: nothing is sorted.
Budgets are nested: whole passes over a source first, then the rest of its target by threshold. At the threshold, the
``NEAR`` next hashes on either side are refined: of all their subsets the one whose sizes come nearest to what is left of
the budget is taken, so a source misses its target by little even where rows are long.

Targets come from histograms too: the rate at which sources fill up is found among the quotients of limit and weight, by
sums over 4,096 buckets of them and, again, of the boundary bucket alone. No task holds all sources.

Defined cases: a null text has size 0, whatever its length a text is split whole; a null source is a source of its own,
last; a source without words has target 0. A row's hash is of its id, source, size and text; rows that are equal in all four
are numbered, and every one after the first hashes its number too, so each is an item of its own, also where they are a third
of all rows. Which of equal rows has which number makes no difference to the result; rows that differ in other columns alone
are numbered in the order of all their columns. Of subsets that come equally near, the one of the lower hashes is taken. An
empty table gives an empty result. Columns of the input pass through ``mixed_documents`` whatever their names, and ``mix_table`` reads id, source and
text alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import n_words
from quern.scratch import scope, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Bits of one level of buckets, and levels.
BITS, LEVELS = 12, 3
#: Hashes on either side of a threshold that are refined.
NEAR = 6
#: Sources up to which their few numbers go to all tasks by broadcast.
MOST_BROADCAST = 50_000


def source_key(source: Column) -> Column:
    """A key without nulls: null is unlike every source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_places(per: DataFrame) -> DataFrame:
    """``per`` with ``__place``: the number of its row in the order of ``__source``, null last, from 0.

    Rows are dealt by ranges; each range is numbered on its own and begins where the ranges before it end.
    """
    ranged = written(per.repartitionByRange(F.col("__source").asc_nulls_last()).withColumn("__range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("__range").count().select(F.col("__range").alias("__of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.col("__source").asc_nulls_last()))
    numbered = ranged.withColumn("__k", inside - 1).join(F.broadcast(starts), F.col("__range") == F.col("__of"))
    return numbered.withColumn("__place", F.col("__start") + F.col("__k")).drop("__range", "__of", "__k", "__start")


def fill_rate(limits: DataFrame, budget: float) -> float:
    """The rate at which sources that get ``weight`` times the rate, but ``limit`` at most, use the budget up; infinite if
    they can't. ``limits``: ``limit`` and ``weight``, positive.

    A source is full when the rate reaches its quotient. Sums over ``2 ** BITS`` buckets of quotients say in which bucket
    the rate lies; that bucket alone is split again. The driver gets a row for each bucket.
    """
    here = limits.withColumn("q", F.col("limit") / F.col("weight"))
    low, high = here.agg(F.min("q"), F.max("q")).first()
    if low is None:
        return float("inf")
    open_weight = here.agg(F.sum("weight")).first()[0]
    full = 0.0
    while True:
        step = (high - low) / (1 << BITS)
        bucket = F.least(F.floor((F.col("q") - low) / step), F.lit((1 << BITS) - 1)) if step > 0 else F.lit(0)
        sums = here.where(F.col("q").between(low, high)).groupBy(bucket.alias("b")).agg(
            F.sum("limit").alias("limit"), F.sum("weight").alias("weight"), F.min("q").alias("low"), F.max("q").alias("high")
        ).collect()  # a row for each bucket
        for r in sorted(sums, key=lambda r: r["b"]):
            if full + r["limit"] + r["high"] * (open_weight - r["weight"]) >= budget:
                break
            full, open_weight = full + r["limit"], open_weight - r["weight"]
        else:
            return float("inf")
        if r["low"] == r["high"] or (r["low"], r["high"]) == (low, high) and len(sums) == 1:
            return (budget - full) / open_weight
        low, high = r["low"], r["high"]


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """``__key, source_size, target`` from rows of ``__key, __source, size``: one row per source.

    Sources weigh ``weights`` in turn, by code point, null last. A source gets its share of ``share`` times all sizes by
    weight, but ``passes`` times its own size at most; what it can't use is shared anew.
    """
    per = sizes.groupBy("__key").agg(F.min("__source").alias("__source"), F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    limit = passes * F.col("source_size").cast("double")
    per = written(source_places(per).select("__key", "source_size", limit.alias("limit"), weight.alias("weight")), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    rate = fill_rate(per.where(F.col("limit") > 0), share * total)
    return per.select("__key", "source_size", F.least(F.col("limit"), F.lit(rate) * F.col("weight")).alias("target"))


def _bucket(level: int) -> Column:
    """The first ``level + 1`` times ``BITS`` bits of the hash, as a number."""
    return F.call_function("shiftrightunsigned", F.col("__h"), F.lit(64 - BITS * (level + 1)))


def _boundary(sums: DataFrame, state: DataFrame, hint) -> DataFrame:
    """``__key, __at, __used``: the first ``__b`` beyond ``__left``, and the sum of those before it. ``sums``: ``__key, __b, __sum``."""
    upto = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = sums.withColumn("__run", F.sum("__sum").over(upto)).join(hint(state.select("__key", "__left")), "__key")
    over = F.col("__run") > F.col("__left")
    return runs.groupBy("__key").agg(F.min(F.when(over, F.col("__b"))).alias("__at"), F.coalesce(F.max(F.when(~over, F.col("__run"))), F.lit(0)).alias("__used"))


def thresholds(rows: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """``__key, __upto, __left``: a source's rows whose first ``BITS * LEVELS`` bits are below ``__upto`` fit its budget,
    and ``__left`` of it stays. ``rows``: ``__key, __h, size``; ``budgets``: ``__key, __budget``.

    Each level knows the boundary bucket of the one before, and sums only that bucket's rows by the next bits. Running sums
    go over the first half of the bits and then, in the boundary there, over the other half, so that no source has a window
    of more than ``2 ** (BITS / 2)`` rows.
    """
    hint = F.broadcast if small else (lambda df: df)
    half = BITS // 2
    state = budgets.select("__key", F.col("__budget").cast("double").alias("__left"), F.lit(0).cast("long").alias("__upto"))
    for level in range(LEVELS):
        here = rows
        if level:
            here = rows.join(hint(state.select("__key", "__upto")), "__key").where(_bucket(level - 1) == F.col("__upto"))
        sums = written(here.groupBy("__key", _bucket(level).alias("__b")).agg(F.sum("size").alias("__sum")), "mix-sums")
        coarse = F.shiftright("__b", half)
        first = _boundary(sums.groupBy("__key", coarse.alias("__b")).agg(F.sum("__sum").alias("__sum")), state, hint)
        first = state.join(first, "__key", "left").select("__key", "__upto", F.col("__at").alias("__coarse"), (F.col("__left") - F.coalesce("__used", F.lit(0))).alias("__left"))
        first = written(first, "mix-half")
        inner = sums.join(hint(first.select("__key", "__coarse")), "__key").where(coarse == F.col("__coarse")).select("__key", "__b", "__sum")
        found = _boundary(inner, first, hint)
        # without a bucket beyond the budget every row fits; a threshold beyond all buckets then stays so on every level
        rest = F.lit(1 << BITS).cast("long") if level == 0 else F.call_function("shiftleft", F.col("__upto"), F.lit(BITS))
        state = first.join(found, "__key", "left").select(
            "__key", (F.col("__left") - F.coalesce("__used", F.lit(0))).alias("__left"), F.coalesce("__at", rest).alias("__upto")
        )
        state = written(state, "mix-level")
    return state


def refined(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """``__key, __near, __take``: the hashes (their first bits) next to each threshold, and those of them to take: of all
    subsets the one that comes nearest to the budget. ``state`` is that of :func:`thresholds`.

    Each task sends ``NEAR`` hashes of either side of a source; a source has ``2 ** (2 * NEAR)`` subsets, as one array.
    """
    hint = F.broadcast if small else (lambda df: df)
    prefix = _bucket(LEVELS - 1)
    near = rows.select("__key", prefix.alias("__p"), "size").join(hint(state), "__key").withColumn("__above", F.col("__p") >= F.col("__upto"))
    order = F.when(F.col("__above"), F.col("__p")).otherwise(-F.col("__p"))
    near = near.withColumn("__n", F.dense_rank().over(Window.partitionBy("__key", "__above").orderBy(order))).where(F.col("__n") <= NEAR)
    each = near.groupBy("__key", "__above", "__p", "__left").agg(F.sum("size").cast("long").alias("size"))
    item = F.struct(F.col("__p").alias("p"), F.col("size").alias("size"), F.col("__above").alias("above"))
    per = each.groupBy("__key").agg(F.first("__left").alias("__left"), F.array_sort(F.collect_list(item)).alias("__items"))  # 2 * NEAR items
    budget = F.col("__left") + F.aggregate("__items", F.lit(0).cast("long"), lambda a, x: a + F.when(x["above"], 0).otherwise(x["size"]))
    per = per.withColumn("__want", budget)
    zero = F.lit(0).cast("long")
    numbered = F.transform("__items", lambda x, i: F.struct(x["size"].alias("size"), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")).alias("bit")))
    start = F.array(F.struct(zero.alias("sum"), zero.alias("mask")))
    sums = F.aggregate(numbered, start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.struct((s["sum"] + x["size"]).alias("sum"), (s["mask"] + x["bit"]).alias("mask")))))
    per = per.withColumn("__sums", sums)
    per = per.withColumn("__best", F.array_min(F.transform("__sums", lambda s: F.struct(F.abs(s["sum"] - F.col("__want")).alias("miss"), s["mask"].alias("mask"))))["mask"])
    chosen = F.filter(F.transform("__items", lambda x, i: F.when(F.col("__best").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))) != 0, x["p"])), lambda p: p.isNotNull())
    return per.select("__key", F.transform("__items", lambda x: x["p"]).alias("__near"), chosen.alias("__take"))


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> tuple[DataFrame, Column, bool]:
    """The decision for each source, and whether its table is small enough to broadcast.

    ``rows``: ``__key, __source, __h, size``. The table has a row for each source: ``source_size``, ``target``, whole
    passes, the threshold and the hashes next to it. The column says how often a row is taken, where its own ``__h`` and
    ``size`` stand beside its source's row.
    """
    per = written(source_targets(rows, weights, share, passes), "mix-targets")
    small = per.count() <= MOST_BROADCAST
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumn("__whole", whole)
    narrow = rows.select("__key", "__h", "size").where(F.col("size") > 0)
    state = thresholds(narrow, per.select("__key", (F.col("target") - F.col("__whole") * F.col("source_size")).alias("__budget")), small)
    near = refined(narrow, state, small)
    plan = per.join(state.select("__key", "__upto"), "__key").join(near, "__key", "left")
    prefix = _bucket(LEVELS - 1)
    none = F.array().cast("array<bigint>")
    inside = F.when(F.array_contains(F.coalesce("__near", none), prefix), F.array_contains(F.coalesce("__take", none), prefix)).otherwise(prefix < F.col("__upto"))
    once_more = F.when(inside & (F.col("size") > 0) & (F.col("__whole") < passes), 1).otherwise(0)
    return written(plan, "mix-plan"), (F.col("__whole") + once_more).cast("int"), small


#: Numbers of equal rows that one task writes out.
BLOCK = 20_000


def _named(docs: DataFrame, text: str, source: str, id_col: str) -> list[Column]:
    """What decides on a row: ``doc_id, __key, __source, size, __of``; the last is the hash that equal rows share."""
    d, body = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    key, size = source_key(F.col(f"`{source}`")), n_words(body)
    return [d.alias("doc_id"), key.alias("__key"), F.col(f"`{source}`").alias("__source"), size.alias("size"), F.xxhash64(d, key, size, body).alias("__of")]


def _hash(of: Column, number: Column) -> Column:
    return F.when(number == 0, of).otherwise(F.xxhash64(of, number))


def _numbered(rows: DataFrame, start: str, count: str) -> DataFrame:
    """A row for each number from ``start`` on, ``count`` of them, as ``__j``; many numbers of one row are dealt to several tasks."""
    end = F.col(start) + F.col(count) - 1
    blocks = rows.withColumn("__b", F.explode(F.sequence(F.col(start), end, F.lit(BLOCK).cast("long"))))
    blocks = blocks.repartition("__of", "__b")
    return blocks.withColumn("__j", F.explode(F.sequence(F.col("__b"), F.least(F.col("__b") + BLOCK - 1, end)))).drop("__b")


def _equal_rows(rows: DataFrame) -> DataFrame | None:
    """``__of`` of rows that others are equal to, or None if there are none."""
    of = written(rows.groupBy("__of").count().where(F.col("count") > 1).select("__of"), "mix-equal")
    return None if of.isEmpty() else of


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _rows(docs: DataFrame, text: str, source: str, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, __key, __source, size, __h`` of every row as a table, and the hashes of equal rows. Texts aren't shuffled."""
    rows = written(docs.select(*_named(docs, text, source, id_col)), "mix-rows")
    equal = _equal_rows(rows)
    if equal is None:
        return rows.withColumn("__h", F.col("__of")), None
    alone = rows.join(_hint(equal), "__of", "left_anti").withColumn("__h", F.col("__of"))
    lumps = rows.join(_hint(equal), "__of", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__zero", F.lit(0).cast("long"))
    each = _numbered(lumps, "__zero", "__n").withColumn("__h", _hash(F.col("__of"), F.col("__j")))
    return written(alone.select(*rows.columns, "__h").unionByName(each.select(*rows.columns, "__h")), "mix-items"), equal


def mix_table(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row: the words the mix takes of it, repeats counted."""
    rows, _ = _rows(docs, text, source, id_col)
    with scope() as keep:
        plan, times, small = mix_plan(rows, **how)
        keep(plan)
    joined = rows.join(F.broadcast(plan) if small else plan, "__key")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, with the columns of ``docs``.

    A row's own columns and its source's thresholds decide, so texts aren't shuffled to find them, but for those of equal rows.
    """
    with scope() as keep:
        rows, equal = _rows(docs, text, source, id_col)
        plan, times, small = mix_plan(rows, **how)
        keep(plan)
        if equal is not None:
            keep(equal)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *_named(docs, text, source, id_col)).drop("__source")
    if equal is None:
        items = packed.withColumn("__h", F.col("__of"))
    else:
        alone = packed.join(_hint(equal), "__of", "left_anti").withColumn("__h", F.col("__of"))
        lumps = packed.join(_hint(equal), "__of", "left_semi").withColumn("__all", F.sha2(F.to_json("__row"), 256))
        lumps = lumps.groupBy("__of", "__all", "doc_id", "__key", "size").agg(F.first("__row").alias("__row"), F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy("__of").orderBy("__all").rowsBetween(Window.unboundedPreceding, -1)
        each = _numbered(lumps.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))), "__from", "__n")
        items = alone.unionByName(each.withColumn("__h", _hash(F.col("__of"), F.col("__j"))).select(*alone.columns))
    joined = items.join(F.broadcast(plan) if small else plan, "__key").withColumn("__times", times).where(F.col("__times") > 0)
    each = joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy"))
    return each.select("__row.*")
