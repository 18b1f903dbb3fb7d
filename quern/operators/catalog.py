"""File-level lexical search over the manifest, notices for files that aren't indexed, and canonical records."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as X
from quern.operators import vector


def score_documents(
    files: DataFrame, terms: Sequence[str], allowed: Sequence[str] = (), preferred: Sequence[str] = (), hints: Sequence[str] = (), statuses: Sequence[str] = ("indexed",),
) -> DataFrame:
    """Files with a positive ``score`` and the ``reasons`` for it.

    The phrase of all terms in the name counts 60, a term in the name 20 or else in the path 5, a hint in the name 30, a
    preferred folder 30. ``allowed`` folders and ``statuses`` are hard filters. One pass over narrow columns.

    A manifest of :mod:`quern.operators.indexing` has ``name_key`` and ``path_key``, names in their NFKC form, which are then
    read; other tables are normalised here, without NFKC, so that no Python runs over the whole manifest.
    """
    terms = [unicodedata.normalize("NFKC", t) for t in terms]
    f = files.where(F.col("status").isin(*statuses))
    if allowed:
        keep = F.lit(False)
        for folder in dict.fromkeys(allowed):
            keep = keep | X.within(F.col("root"), folder)
        f = f.where(keep)
    key = lambda c: F.coalesce(f"{c}_key", X.normalize(F.col(c))) if f"{c}_key" in files.columns else X.normalize(F.col(c))
    f = f.withColumns({"__name": key("name"), "__path": key("path")})
    name, path = F.col("__name"), F.col("__path")
    parts: list[tuple[Column, int, str]] = []
    if terms:
        parts.append((name.contains(" ".join(terms)), 60, "name has the phrase"))
    for t in terms:
        parts.append((name.contains(t), 20, f"name has '{t}'"))
        parts.append((~name.contains(t) & path.contains(t), 5, f"path has '{t}'"))
    for h in dict.fromkeys(h for h in hints if h):
        parts.append((name.contains(X.normalize(F.lit(h))), 30, f"name has hint '{h}'"))
    for folder in dict.fromkeys(r for r in preferred if r):
        parts.append((X.within(F.col("root"), folder), 30, "preferred folder"))
    if not parts:
        return f.drop("__name", "__path").where(F.lit(False)).withColumns({"score": F.lit(0.0), "reasons": F.array().cast("array<string>")})
    score = F.lit(0)
    for holds, points, _ in parts:
        score = score + F.when(holds, points).otherwise(0)
    reasons = F.filter(F.array(*[F.when(holds, F.lit(text)) for holds, _, text in parts]), lambda x: x.isNotNull())
    return f.withColumns({"score": score.cast("double"), "reasons": reasons}).drop("__name", "__path").where(F.col("score") > 0)


def search_documents(files: DataFrame, terms: Sequence[str], limit: int = 5, **how) -> DataFrame:
    """The best files, ties in manifest order (``seq``)."""
    return score_documents(files, terms, **how).orderBy(F.col("score").desc(), "seq").limit(limit)


def unindexed_notice(files: DataFrame, terms: Sequence[str], **how) -> DataFrame:
    """At most one row: the best skipped file, if its name alone is evidence: the phrase, or a term that isn't generic."""
    best = search_documents(files, terms, limit=3, statuses=("skipped",), **how).orderBy(F.col("score").desc(), "seq").limit(1)
    specific = [f"name has '{t}'" for t in terms if t not in fixed.NOTICE_GENERIC]
    evident = F.arrays_overlap("reasons", X.array_of(["name has the phrase", *specific]))
    return best.where(evident).withColumns({"reason": X.friendly_reason(F.col("error")), "link": X.file_link(F.col("file_id"))})


def canonical_intents(queries: DataFrame, records: DataFrame) -> DataFrame:
    """The first record (by ``ord``) that fits each query: one of its intent terms, one of its context terms if it has
    any, none of those that exclude it. ``records`` is a small reference table and is broadcast after a size check."""
    n = records.count()
    small = F.broadcast if n <= 10_000 else (lambda x: x)
    q = queries.withColumn("__n", X.normalize(F.col("q")))
    has = lambda terms: F.exists(terms, lambda t: F.col("__n").contains(X.normalize(t)))
    fits = has(F.col("intent_terms")) & ((F.size("context_terms") == 0) | has(F.col("context_terms"))) & ~has(F.col("exclude_if_present"))
    return q.join(small(records), fits, "left").groupBy("id").agg(F.min_by("key", "ord").alias("record"))


def nearest_of_files(best: DataFrame, points: DataFrame, query: Sequence[float], per_file: int) -> DataFrame:
    """``file_id, idx, score`` and the columns of ``best``: of each of its files the chunks nearest to the query.

    ``best`` has a few files, so the vectors of no other file are read beyond the join, and at most ``per_file`` rows of a
    file leave a task.
    """
    hits = vector.scored(points.join(F.broadcast(best), "file_id"), query)
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("score").desc(), "idx"))
    return hits.withColumn("__k", place).where(F.col("__k") <= per_file).select("idx", "score", *best.columns)


def lexical_candidates(
    files: DataFrame, chunks: DataFrame, points: DataFrame, query: Sequence[float], terms: Sequence[str], max_files: int = fixed.LEXICAL_FILES, per_file: int = fixed.LEXICAL_CHUNKS, **how
) -> DataFrame:
    """The chunks nearest to the query of the best files by name, with ``name_score``, ``seq`` and ``score``."""
    best = search_documents(files, terms, limit=max_files, **how).select("file_id", F.col("score").alias("name_score"), "seq")
    near = nearest_of_files(best, points, query, per_file)
    return chunks.drop("seq").join(F.broadcast(near), ["file_id", "idx"])  # max_files * per_file rows at most


def synopsis_candidates(
    synopses: DataFrame, chunks: DataFrame, points: DataFrame, query: Sequence[float], roots: Sequence[str] | None = None,
    max_files: int = fixed.SYNOPSIS_FILES, per_file: int = fixed.SYNOPSIS_CHUNKS,
) -> DataFrame:
    """The chunks nearest to the query of the files whose synopsis is nearest, with ``synopsis``, ``file_score`` and ``score``.
    ``synopses``: ``file_id, root, synopsis, vector``."""
    top = vector.search(synopses, query, max_files, roots=roots, ties=("file_id",))
    top = top.select("file_id", "synopsis", F.col("score").alias("file_score"))
    near = nearest_of_files(top, points.where(F.col("root").isin(list(roots))) if roots else points, query, per_file)
    return chunks.drop("seq").join(F.broadcast(near), ["file_id", "idx"])


def load_records(spark, path: str) -> DataFrame:
    """Canonical records of a JSON file as a table, in the order of the file. ``records`` is an object ``{key: {...}}`` or a list
    of objects with a ``key`` each; an error if the file has another form or a key twice."""
    text = spark.read.text(path, wholetext=True).first()
    value = json.loads(text[0]) if text else None
    records = value.get("records") if isinstance(value, dict) else None
    if isinstance(records, list):
        keys = [r.get("key") if isinstance(r, dict) else None for r in records]
        if not all(keys) or len(set(keys)) < len(keys):
            raise ValueError(f"records of {path} need a key of their own each")
        records = dict(zip(keys, records, strict=True))
    if not isinstance(records, dict):
        raise ValueError(f"{path} is not an object with records")
    lists = ("intent_terms", "context_terms", "exclude_if_present", "preferred_roots", "filename_hints")
    rows = [(i, k, *[list(r.get(x) or []) for x in lists], r.get("operation", "canonical_record")) for i, (k, r) in enumerate(records.items())]
    return spark.createDataFrame(rows, "ord int, key string, " + ", ".join(f"{x} array<string>" for x in lists) + ", operation string")
