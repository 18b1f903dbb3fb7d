"""Quality rules as a short-circuit cascade, built from DataFrame functions only.

Each rule rejects a text. On a sample the cascade measures what each rule costs (seconds for the sample) and which rows
it rejects, then orders the rules greedily by the rejections that are still new per second. On the full input a rule
reads only texts that every earlier rule let pass; what it needs is computed under that guard.

Defined cases: a null text counts as empty and fails ``short``; a text of any length is judged whole, with arrays of its
words; rows are judged one by one, so repeated rows and ties get equal verdicts; an empty table gives an empty result; columns of the input pass through, whatever their names. The order
of the rules depends on measured times; verdicts don't, since a text is kept only if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import SPACES, fresh, trimmed, words

#: Rows that the estimate looks at, about, drawn from the whole table.
SAMPLE_ROWS = 1_000
SEED = 7
WINDOW = 8


def _count(text: Column, other: str) -> Column:
    """Characters left when the class ``other`` is taken out."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """``steps`` are named columns, computed one after another; ``rejects`` is a condition on them, ``text`` and ``n``."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    steps: Sequence[tuple[str, Callable[[dict[str, Column]], Column]]] = field(default=())


def repeat_steps() -> list[tuple[str, Callable[[dict[str, Column]], Column]]]:
    """Words in 8-word windows found twice or more in the text, the first find included.

    Window hashes are sorted with their places; equal neighbours mark places; each place adds the words up to the next
    one, 8 at most. Texts without an equal pair skip the sort. Every step names its input twice or more, so that Catalyst
    keeps it as one column and doesn't compute it anew for each element.
    """

    def joined(of: str, apart: int):
        """Hashes of an item and of the one ``apart`` places on: of pairs, of four, of eight words."""

        def make(c):
            h = c[of]
            n = F.greatest(F.size(h) - apart, F.lit(0))
            return F.zip_with(F.slice(h, 1, n), F.slice(h, apart + 1, n), lambda a, b: F.xxhash64(a, b))

        return make

    def ordered(c):
        w = c["windows"]
        return F.when(
            F.size(F.array_distinct(w)) < F.size(w),
            F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )

    def places(c):
        s = c["ordered"]
        marked = F.transform(
            s, lambda x, i: F.when(F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]), x["i"])
        )
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def repeated(c):
        p = c["places"]
        each = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))

    return [
        ("words", lambda c: words(c["text"])),
        ("hashes", lambda c: F.transform(c["words"], lambda w: F.xxhash64(w))),
        ("pairs", joined("hashes", 1)),
        ("fours", joined("pairs", 2)),
        ("windows", joined("fours", 4)),
        ("ordered", ordered),
        ("places", places),
        ("n_repeat_words", repeated),
    ]


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def dup_line_steps() -> list[tuple[str, Callable[[dict[str, Column]], Column]]]:
    return [
        ("lines", lambda c: _worded_lines(c["text"])),
        ("n_dup_lines", lambda c: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long")),
    ]


#: What a text must not be. Shares are of its words or of its characters in words.
RULES: tuple[Rule, ...] = (
    Rule("short", lambda c: c["n_words"] < 20),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"], [("n_symbols", lambda c: _count(c["text"], r"[^#*$%&|<>]+"))]),
    Rule("shouting", lambda c: 4 * c["n_upper"] > c["word_chars"], [("n_upper", lambda c: _count(c["text"], "[^A-Z]+"))]),
    Rule("exclaiming", lambda c: 10 * c["n_marks"] > c["n_words"], [("n_marks", lambda c: _count(c["text"], "[^!]+"))]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])),
    Rule("same_lines", lambda c: 2 * c["n_dup_lines"] > F.size(c["lines"]), dup_line_steps()),
    Rule("repeats", lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"], repeat_steps()),
)


def _with_base(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """Adds what every rule may read: the text with null as empty, its words' number and characters."""
    t, n, chars = fresh(df, "text", "n_words", "word_chars")
    bare = trimmed(F.col(f"`{text}`"))
    df = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumns({
        n: F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long"),
        chars: _count(F.col(t), r"[\x20\x09-\x0D]+"),
    })
    return df, {"text": t, "n_words": n, "word_chars": chars}


def with_steps(df: DataFrame, names: dict[str, str], steps, guard: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Adds the steps one by one, each under the guard; those that are there already stay."""
    names = dict(names)
    for name, make in steps:
        if name in names:
            continue
        (at,) = fresh(df, name)
        value = make({k: F.col(v) for k, v in names.items()})
        df = df.withColumn(at, value if guard is None else F.when(guard, value))
        names[name] = at
    return df, names


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float
    rejected: int
    rows: int
    new_rejected: int


def _seconds(df: DataFrame) -> float:
    """The shorter of two runs: the first one also compiles code."""
    took = []
    for _ in range(2):
        start = time.perf_counter()
        df.collect()
        took.append(time.perf_counter() - start)
    return min(took)


def estimate_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order of the cascade, with what the sample shows of each.

    The sample has about ``sample_rows`` rows of the whole table, each drawn on its own, so that copies of one text, however
    many, come in by their share. Each rule runs alone over it for its cost; one more job counts each combination of
    verdicts, from which rejections among the rows still alive follow. A cost below a millisecond counts as one: the order
    of rules that cheap follows their rejections; ties keep the given order.
    """
    n = docs.count()
    only = docs.select(F.col(f"`{text}`").alias("text"))
    only = (only.sample(min(1.0, sample_rows / n), SEED) if n > sample_rows else only).persist()
    try:
        rows = only.count()
        base, names = _with_base(only, "text")
        floor = _seconds(base.agg(F.sum(names["n_words"]), F.sum(names["word_chars"])))
        costs, flags, every, known = {}, {}, base, names
        for rule in rules:
            one, known_one = with_steps(base, names, rule.steps)
            took = _seconds(one.agg(F.count_if(rule.rejects({k: F.col(v) for k, v in known_one.items()}))))
            costs[rule.name] = max(1e-3, took - floor)
            every, known = with_steps(every, known, rule.steps)
            (flags[rule.name],) = fresh(every, f"r_{rule.name}")
            every = every.withColumn(flags[rule.name], rule.rejects({k: F.col(v) for k, v in known.items()}))
        seen = every.groupBy(*flags.values()).count().collect()  # 2 ** rules rows at most
    finally:
        only.unpersist()
    at = {r.name: flags[r.name] for r in rules}
    left, out, rest = list(seen), [], list(rules)
    while rest:
        gain = {r.name: sum(x["count"] for x in left if x[at[r.name]]) for r in rest}
        best = max(rest, key=lambda r: (gain[r.name] / costs[r.name], -rules.index(r)))
        out.append(Estimate(best.name, costs[best.name], sum(x["count"] for x in seen if x[at[best.name]]), rows, gain[best.name]))
        left = [x for x in left if not x[at[best.name]]]
        rest.remove(best)
    return out


def fenced(verdict: Column) -> Column:
    """The verdict, such that filters on the result stay above it.

    Catalyst would move them below the cascade's projections and inline the arrays into the condition, where each element
    computes them anew; it moves none past a projection that isn't deterministic.
    """
    return verdict & (F.monotonically_increasing_id() >= 0)


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", order: Sequence[str] | None = None, kept: str = "kept") -> DataFrame:
    """``docs`` with a boolean ``kept``: no rule rejects the text. A column of that name is replaced.

    ``order`` names the rules in the order to try; by default :func:`estimate_rules` finds it.
    """
    order = list(order) if order is not None else [e.rule for e in estimate_rules(docs, rules, text)]
    by_name = {r.name: r for r in rules}
    df, names = _with_base(docs, text)
    alive: Column | None = None
    for name in order:
        rule = by_name[name]
        df, names = with_steps(df, names, rule.steps, alive)
        (flag,) = fresh(df, f"alive_{name}")
        passes = ~F.coalesce(rule.rejects({k: F.col(v) for k, v in names.items()}), F.lit(True))
        df = df.withColumn(flag, passes if alive is None else F.when(alive, passes).otherwise(F.lit(False)))
        alive = F.col(flag)
    out = [F.col(f"`{c}`") for c in docs.columns if c.lower() != kept.lower()]
    return df.select(*out, fenced(alive if alive is not None else F.lit(True)).alias(kept))


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with the columns of ``docs``."""
    (flag,) = fresh(docs, "kept")
    return judged(docs, rules, text, kept=flag).where(F.col(flag)).drop(flag)


def quality_table(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, five statistics, ``base_failed`` and ``kept``.

    The statistics are wanted for every row, so they come first; the cascade then reads them and computes only what is
    missing, under its guards.
    """
    order = [e.rule for e in estimate_rules(docs, rules, text)]
    df = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias(text))
    df, names = _with_base(df, text)
    shown = [("n_symbols", RULES[1].steps[0][1]), *dup_line_steps(), *repeat_steps()]
    df, names = with_steps(df, names, shown)
    by_name = {r.name: r for r in rules}
    c = lambda k: F.col(names[k])
    (failed,) = fresh(df, "base_failed")
    df = df.withColumn(failed, (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words")))
    alive = ~F.col(failed)
    for name in order:
        rule = by_name[name]
        df, names = with_steps(df, names, rule.steps, alive)
        (flag,) = fresh(df, f"alive_{name}")
        df = df.withColumn(flag, F.when(alive, ~F.coalesce(rule.rejects({k: F.col(v) for k, v in names.items()}), F.lit(True))).otherwise(F.lit(False)))
        alive = F.col(flag)
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(id_col, *[F.col(names[k]).cast("long").alias(k) for k in stats], F.col(failed).alias("base_failed"), fenced(alive).alias("kept"))
