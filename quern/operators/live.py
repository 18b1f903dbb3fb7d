"""Live lookups on snapshot tables: predicates of a name search, web results and their counters, citations by channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.fusion import merge_candidates, with_rank

EACH_TERM, FULL_TEXT_TERMS, MOST_RESULTS, MOST_QUERY_CHARS = 3, 4, 5, 400


def predicates(terms: Sequence[str], file_name: str = "") -> list[tuple[str, Column]]:
    """Name and condition of each search, in order, at most five: a file name alone if there is one; else all terms in the
    name, each of the first three, and any of the first four in the text."""
    name, body = F.lower(F.col("name")), F.lower(F.coalesce(F.col("text"), F.lit("")))
    if file_name:
        return [("exact", name.contains(file_name.lower()))]
    low = [t.lower() for t in terms if t]
    if not low:
        return []
    every, some = F.lit(True), F.lit(False)
    for t in low:
        every = every & name.contains(t)
    for t in low[:FULL_TEXT_TERMS]:
        some = some | body.contains(t)
    each = [(f"name:{t}", name.contains(t)) for t in low[:EACH_TERM]] if len(low) > 1 else []
    return [("all", every), *each, ("text", some)]


def search(items: DataFrame, terms: Sequence[str], file_name: str = "", per_search: int = 20) -> DataFrame:
    """Items of the searches, distinct by id, without trashed ones; ``pos`` is their place. If the first search finds any
    item, the others don't count: one scan answers all of them, and a broadcast row says whether the first did."""
    tests = predicates(terms, file_name)
    live = items.where(~F.col("trashed"))
    if not tests:
        return live.where(F.lit(False)).withColumn("pos", F.lit(0))
    first = live.agg(F.coalesce(F.max(tests[0][1]), F.lit(False)).alias("__first"))
    lists = []
    for k, (_, test) in enumerate(tests):
        found = live.where(test).orderBy(F.col("modified").desc(), "file_id").limit(per_search)
        found = with_rank(found, "pos", F.col("modified").desc(), F.col("file_id"))
        lists.append(found if k == 0 else found.crossJoin(F.broadcast(first)).where(~F.col("__first")).drop("__first"))
    merged = merge_candidates(lists, keys=("file_id",), notes=())
    return with_rank(merged.drop("pos"), "pos", F.col("branch"), F.col("modified").desc(), F.col("file_id")).drop("branch")


def web_results(results: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """Results with a usable link, one-line titles, ``most`` (1 to 5) of each query of at most 400 characters."""
    from pyspark.sql import Window

    usable = results.withColumns({"url": X.clean_url(F.col("url")), "title": X.clean_title(F.col("title"))}).where((F.col("url") != "") & (F.length("q") <= MOST_QUERY_CHARS))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "url"))
    return usable.withColumn("k", place).where(F.col("k") <= max(1, min(MOST_RESULTS, most)))


def web_metrics(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Counts of queries: calls, with results, without, skipped as too long. ``queries``: ``id, q``."""
    n = web_results(results.join(queries, "id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    j = queries.join(n, "id", "left")
    long = F.length("q") > MOST_QUERY_CHARS
    return j.agg(F.count_if(~long).alias("calls"), F.count_if(~long & (F.col("n") > 0)).alias("ok"), F.count_if(~long & F.col("n").isNull()).alias("empty"), F.count_if(long).alias("skipped_too_long"))


def channels_of(citations: DataFrame) -> DataFrame:
    """How often each channel stands in citations like ``#name · ...``."""
    return citations.where(F.col("citation").startswith("#")).groupBy(F.regexp_extract("citation", r"^#(\S+)", 1).alias("channel")).agg(F.count(F.lit(1)).alias("n"))
