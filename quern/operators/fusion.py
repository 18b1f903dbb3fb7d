"""Putting candidate lists together: merge, rank fusion, trimming, balancing, neighbours, near-duplicate removal.

Candidates are at most some hundreds of rows (each list was cut to its top k before), so windows over all of them are
cheap. What runs over whole tables says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.scratch import written


def keep_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition, or all rows if none does. One aggregate row is broadcast, so this is fine for
    tables of any size."""
    holds = F.coalesce(condition, F.lit(False))
    found = df.agg(F.coalesce(F.max(holds), F.lit(False)).alias("__any"))
    return df.crossJoin(F.broadcast(found)).where(holds | ~F.col("__any")).drop("__any")


def merge_candidates(lists: list[DataFrame], keys: tuple[str, ...] = ("file_id", "idx"), notes: tuple[str, ...] = ("synopsis", "parent_context")) -> DataFrame:
    """An ordered union without repeats: of rows with equal keys the first stays, by list and then by ``pos``; notes that
    it lacks come from the later ones. Adds ``branch``."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("branch", F.lit(i)) for i, x in enumerate(lists)])
    order = Window.partitionBy(*keys).orderBy("branch", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = every.withColumns({n: F.first(n, ignorenulls=True).over(whole) for n in notes if n in every.columns})
    return filled.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """:func:`with_rank` by columns for tables of any size: rows are dealt into ranges and numbered in each, from where the
    ranges before it end."""
    placed = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__at", at).join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__at")).drop("__range", "__at", "__start")


def rrf(ranks: list[Column], k: int = fixed.RRF_K) -> Column:
    """Reciprocal rank fusion: the sum of ``1 / (k + rank)`` over the lists that have the row."""
    return reduce(lambda a, b: a + b, [F.coalesce(1.0 / (F.lit(float(k)) + r), F.lit(0.0)) for r in ranks])


def confidence(lexical_rank: Column, synopsis_rank: Column) -> Column:
    return F.when(lexical_rank.isNotNull() & synopsis_rank.isNotNull(), "high").when(lexical_rank <= 5, "medium").otherwise("low")


def fuse_locations(lexical: DataFrame, synopsis: DataFrame) -> DataFrame:
    """``file_id`` with both ranks, the synopsis score, ``rrf`` and ``confidence``. Inputs: ``file_id, rank`` (and ``score``)."""
    a = lexical.select("file_id", F.col("rank").alias("lexical_rank"))
    b = synopsis.select("file_id", F.col("rank").alias("synopsis_rank"), F.col("score").alias("synopsis_score"))
    both = a.join(b, "file_id", "full_outer")
    lex, syn = F.col("lexical_rank"), F.col("synopsis_rank")
    return both.withColumns({"rrf": rrf([lex, syn]), "confidence": confidence(lex, syn)})


def trim_weak(files: DataFrame, ratio: float = fixed.WEAK_RATIO, most: int = fixed.TOP_FILES) -> DataFrame:
    """Without rows that only the synopsis found and whose score is below a share of the best one; then the first few."""
    best = F.max("synopsis_score").over(Window.partitionBy(F.lit(0)))
    weak = F.col("lexical_rank").isNull() & F.col("synopsis_rank").isNotNull() & (F.col("synopsis_score") < best * ratio)
    kept = files.withColumn("__weak", F.coalesce(weak, F.lit(False))).where(~F.col("__weak")).drop("__weak")
    return kept.orderBy(F.col("rrf").desc(), "file_id").limit(most)


def merge_live(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed files and live items by id: live names, paths and times win, ranks add up, and both are told apart.

    Every live item counts, with its rank by ``pos`` before items in the trash or outside the root go. Live items may be any
    number; those that have a ``live_rank`` keep it.
    """
    ranked = live if "live_rank" in live.columns else numbered(live, "live_rank", "pos", "file_id")
    usable = ranked.where(~F.col("trashed") & F.col("inside_root"))
    a, b = indexed.alias("a"), usable.alias("b")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    more = [pick(c) if c in indexed.columns and c in live.columns else F.col(c) for c in ("created", "mime_type") if c in indexed.columns or c in live.columns]
    return a.join(b, F.col("a.file_id") == F.col("b.file_id"), "full_outer").select(
        F.coalesce("a.file_id", "b.file_id").alias("file_id"), pick("name"), pick("path"), pick("modified"), *more,
        (F.coalesce("a.rrf", F.lit(0.0)) + rrf([F.col("b.live_rank")])).alias("rrf"),
        F.when(F.col("a.file_id").isNull(), "live").when(F.col("b.file_id").isNull(), "indexed").otherwise("both").alias("provenance"),
    )


def by_recency(hits: DataFrame, stamp: str) -> DataFrame:
    """``hits`` ranked anew: the latest first, a missing time last, equal times as before."""
    newest = F.struct(F.coalesce(stamp, F.lit("")).alias("t"), (-F.col("rank")).alias("r")).desc()
    return hits.withColumn("__new", F.row_number().over(Window.orderBy(newest))).drop("rank").withColumnRenamed("__new", "rank")


def order_locations(files: DataFrame, wanted_name: str = "", year: str = "", most: int | None = fixed.TOP_FILES, folder: bool = False) -> DataFrame:
    """By exact name, by stem, by being a folder if one was asked for, by the year in the name, by being in both lists, by
    fused rank, then name: all descending. A table without ``mime_type`` has no folders."""
    name = X.normalize(F.col("name"))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    wanted = F.lit(wanted_name)
    keys = {
        "exact": (name == X.normalize(wanted)) if wanted_name else F.lit(False),
        "same_stem": (X.normalize(stem(F.col("name"))) == X.normalize(stem(wanted))) if wanted_name else F.lit(False),
        "is_folder": F.coalesce(F.col("mime_type") == fixed.FOLDER_MIME, F.lit(False)) if folder and "mime_type" in files.columns else F.lit(False),
        "year_name": F.col("name").contains(year) if year else F.lit(False),
        "in_both": F.col("provenance") == "both",
    }
    ordered = files.withColumns(keys).orderBy(*[F.col(k).desc() for k in keys], F.col("rrf").desc(), name.desc(), "file_id")
    return (ordered.limit(most) if most is not None else ordered).drop(*keys)


def order_locations_by_time(files: DataFrame, mode: str = "modified", year: str = "", month: str = "", most: int = fixed.TOP_FILES, named: bool = True) -> DataFrame:
    """Only files of the year (and month), by their time or their name, or all if there are none; then by the year in the
    name and the fused rank if a year was asked for, by the asked time, the other one, and the name: all descending. Unless
    ``named``, digits in names are no years."""
    from quern.functions import dates

    first, second = ("created", "modified") if mode == "created" else ("modified", "created")
    stamp = lambda c: F.coalesce(F.col(c), F.lit("")) if c in files.columns else F.lit("")
    name = X.normalize(F.col("name"))
    if year:
        at = stamp(first)
        there = at.startswith(year) & ((F.substring(at, 6, 2) == month) if month else F.lit(True))
        files = keep_or_all(files, (there | dates.name_has_year(name, year, month)) if named else there)
    keys = [F.coalesce(dates.name_has_year(name, year), F.lit(False)).desc()] if year and named else []
    keys += [F.col("rrf").desc()] if year else []
    return files.orderBy(*keys, stamp(first).desc(), stamp(second).desc(), name.desc(), "file_id").limit(most)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, top: int = 1, radius: int = 1) -> DataFrame:
    """Hits with the chunks beside the first ``top`` of them, which take over score and place; nothing twice.

    A band join on the file and an index range; the hits' side has ``top`` rows.
    """
    first = hits.where(F.col("rank") <= top).select(F.col("file_id").alias("of"), F.col("idx").alias("at"), F.col("rank").alias("of_rank"), F.col("score").alias("of_score"))
    beside = chunks.join(F.broadcast(first), (F.col("file_id") == F.col("of")) & F.col("idx").between(F.col("at") - radius, F.col("at") + radius) & (F.col("idx") != F.col("at")))
    new = beside.join(F.broadcast(hits.select("file_id", "idx")), ["file_id", "idx"], "left_anti").select("file_id", "idx", F.col("of_rank").alias("rank"), F.col("of_score").alias("score"), F.lit(1).alias("is_neighbour"))
    new = new.groupBy("file_id", "idx").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.lit(1).alias("is_neighbour"))
    return hits.select("file_id", "idx", "rank", "score", F.lit(0).alias("is_neighbour")).unionByName(new)


def balance_sources(hits: DataFrame, k: int, kinds: tuple[str, ...] = ("drive", "slack")) -> DataFrame:
    """The first k rows by ``rank``, where each kind that has rows keeps one at least.

    A missing kind's best row joins if there is room; else it takes the place of the last row of a kind with several.
    """
    by_rank = Window.partitionBy(F.lit(0)).orderBy("rank")
    ranked = hits.withColumns({"__n": F.row_number().over(by_rank), "__k": F.row_number().over(Window.partitionBy("kind").orderBy("rank"))})
    top = ranked.withColumn("__top", F.col("__n") <= k)
    all_rows = Window.partitionBy(F.lit(0))
    for kind in kinds:
        top = top.withColumn(f"__has_{kind}", F.max((F.col("kind") == kind) & F.col("__top")).over(all_rows))
    lacking = reduce(lambda a, b: a | b, [(F.col("kind") == x) & ~F.col(f"__has_{x}") & (F.col("__k") == 1) for x in kinds])
    top = top.withColumn("__lacking", lacking)
    need = F.sum(F.col("__lacking").cast("int")).over(all_rows) - F.greatest(F.lit(0), F.lit(k) - F.count(F.lit(1)).over(all_rows))
    per_kind = F.sum(F.col("__top").cast("int")).over(Window.partitionBy("kind"))
    top = top.withColumns({"__need": need, "__many": F.col("__top") & (per_kind > 1)})
    last = F.row_number().over(Window.partitionBy("__many").orderBy(F.col("rank").desc()))
    gone = F.col("__many") & (last <= F.col("__need"))
    return top.withColumn("__gone", gone).where((F.col("__top") & ~F.col("__gone")) | F.col("__lacking")).select(*hits.columns)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def drop_similar(hits: DataFrame, k: int, threshold: float = fixed.SIMILAR, text: str = "text") -> DataFrame:
    """Rows in rank order, each kept unless its token set is too similar to one kept before, k at most.

    What is kept depends on what was kept before, so it is a fold over one array. The array holds the candidates of one
    query, some tens of rows.
    """
    item = F.struct("rank", "id", X.token_set(F.col(text)).alias("tokens"))
    packed = hits.agg(F.array_sort(F.collect_list(item)).alias("rows"))
    empty = F.filter("rows", lambda _: F.lit(False))
    similar = lambda kept, x: F.exists(kept, lambda y: F.when(F.size(F.array_union(y["tokens"], x["tokens"])) == 0, F.lit(False)).otherwise(jaccard(y["tokens"], x["tokens"]) >= threshold))
    kept = F.aggregate("rows", empty, lambda acc, x: F.when((F.size(acc) >= k) | similar(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return packed.select(F.explode(kept).alias("x")).select("x.rank", "x.id")
