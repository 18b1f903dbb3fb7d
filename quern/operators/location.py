"""Where a file is: file-level search by name and synopsis, alone or together with a live listing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import intent as I
from quern.functions import text as X
from quern.operators import catalog, deadline, fusion, vector
from quern.scratch import written


@dataclass(frozen=True)
class Located:
    """``files``: ``file_id, name, location, status, mod_time, rrf, confidence, ...``, best first by ``rank``."""

    intent: str
    files: DataFrame
    note: str = ""
    live: str = ""


def evaluate(spark: SparkSession, **columns: Column):
    """One row of expressions over constants."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def search_files(files: DataFrame, terms: Sequence[str], synopses: DataFrame | None = None, query: Sequence[float] | None = None, roots: Sequence[str] | None = None, depth: int = fixed.SIGNAL_DEPTH) -> DataFrame:
    """The best files by name and by synopsis, fused and trimmed. Chunks aren't read.

    Names of skipped files count too. A synopsis keeps its place in the list if the manifest has lost its file, which is then
    left out. Lists have ``depth`` rows.
    """
    lex = catalog.search_documents(files, terms, limit=depth, allowed=roots or (), statuses=("indexed", "skipped"))
    lex = fusion.with_rank(lex.select("file_id", "score", "seq"), "rank", F.col("score").desc(), F.col("seq"))
    if synopses is None or query is None:
        syn = lex.limit(0).select("file_id", "rank", F.lit(0.0).alias("score"), F.lit("").alias("synopsis"))
    else:
        syn = vector.search(synopses, query, depth, roots=roots, ties=("file_id",)).select("file_id", "synopsis", "score")
        syn = fusion.with_rank(syn, "rank", F.col("score").desc(), F.col("file_id"))
        syn = syn.join(F.broadcast(files.join(F.broadcast(syn.select("file_id")), "file_id", "left_semi").select("file_id")), "file_id", "left_semi")
    fused = fusion.trim_weak(fusion.fuse_locations(lex, syn))
    told = fused.join(syn.select("file_id", "synopsis"), "file_id", "left")
    f = files.select("file_id", "name", "root", "path", "status", "mod_time", "error", "n_chunks")
    out = f.join(F.broadcast(told), "file_id").withColumn("location", F.concat_ws("/", "root", "path"))
    return fusion.with_rank(out, "rank", F.col("rrf").desc(), F.col("file_id"))


def left_to_others(q: Column, record: bool) -> Column:
    """Whether a question belongs to the folder listing or to a canonical record."""
    return q.rlike(fixed.LIST_FOLDER) | F.lit(record)


def decide(spark: SparkSession, question: str, records: DataFrame | None = None, force: bool = False) -> str | None:
    """The intent of a location question, or None if something else answers it. A forced question is one of location."""
    q = F.lit(question)
    found = evaluate(spark, intent=I.location_intent(q), listing=q.rlike(fixed.LIST_FOLDER))
    if not force:
        if found["listing"] or found["intent"] == "content":
            return None
        if records is not None:
            one = catalog.canonical_intents(spark.range(1).select("id", q.alias("q")), records).first()
            if one is not None and one["record"] is not None:
                return None
    return "location" if found["intent"] == "content" else found["intent"]


def locate(
    spark: SparkSession, question: str, files: DataFrame, synopses: DataFrame | None = None, query: Sequence[float] | None = None, roots: Sequence[str] | None = None,
    records: DataFrame | None = None, force: bool = False,
) -> Located | None:
    """Files for a location question; None if it isn't one, or if it may not be one and no file is found."""
    kind = decide(spark, question, records, force)
    if kind is None:
        return None
    terms = list(evaluate(spark, t=X.lexical_terms(F.lit(question)))["t"])
    found = search_files(files, terms, synopses, query, roots)
    if kind == "ambiguous":
        if not force and not found.limit(1).count():
            return None
        return Located(kind, found, fixed.AMBIGUOUS_NOTE)
    return Located(kind, found)


def locate_hybrid(spark: SparkSession, question: str, files: DataFrame, live: Callable[[], DataFrame] | None = None, seconds: float = fixed.LIVE_SECONDS, **how) -> Located | None:
    """:func:`locate`, with what a live listing finds. ``live`` gives ``file_id, name, path, modified, trashed, inside_root, pos``
    (and ``created, mime_type``), of which the first ``fixed.LIVE_MOST`` count. Both searches run at once. If there is no live
    one, it fails or isn't there after ``seconds``, its jobs are cancelled, the indexed files stay, and ``live`` says so."""
    if live is None:
        found = locate(spark, question, files, **how)
        return found if found is None else Located(found.intent, found.files, found.note, "unavailable")
    first = lambda: written(live().orderBy("pos").limit(fixed.LIVE_MOST), "live")
    both = deadline.together(spark, {"indexed": lambda: locate(spark, question, files, **how), "live": first}, seconds, awaited=("indexed",))
    if both["indexed"].error is not None:
        raise both["indexed"].error
    found, listing = both["indexed"].value, both["live"].value
    if found is None:
        return None
    if listing is None:
        return Located(found.intent, found.files, found.note, both["live"].state)
    indexed = found.files.select("file_id", "name", F.col("location").alias("path"), F.col("mod_time").alias("modified"), "rrf")
    q = F.lit(question)
    said = evaluate(
        spark, quoted=F.regexp_extract(q, fixed.LOCATE_QUOTED, 1), bare=F.regexp_extract(q, fixed.LOCATE_FILE, 1), year=F.regexp_extract(q, fixed.LOCATE_YEAR, 1),
        month=F.lpad(F.nullif(F.regexp_extract(q, fixed.LOCATE_MONTH, 1), F.lit("")), 2, "0"), folder=q.rlike(fixed.LOCATE_FOLDER),
        timed=q.rlike(f"{fixed.LOCATE_RECENT}|{fixed.CREATED_WORD}|{fixed.MODIFIED_WORD}"), mode=I.timestamp_mode(q),
    )
    merged = fusion.merge_live(indexed, fusion.with_rank(listing, "live_rank", F.col("pos")))  # over fixed.LIVE_MOST rows
    if said["timed"]:
        out = fusion.order_locations_by_time(merged, said["mode"], said["year"], said["month"] or "")
    else:
        out = fusion.order_locations(merged, said["quoted"] or said["bare"], said["year"], folder=said["folder"])
    return Located(found.intent, out, found.note, "ok")


def fallback(live_enabled: Column, status: Column) -> Column:
    """What an answer says if a live listing was wanted and isn't part of it; empty otherwise."""
    return F.when(live_enabled & ~F.coalesce(status == "ok", F.lit(False)), fixed.LIVE_FALLBACK).otherwise("")


def table_rows(files: DataFrame, provenance: bool = False) -> DataFrame:
    """One row: the located files as lines of a Markdown table, in order of ``rank``; paths are written as they are."""
    from quern.operators.prompts import joined

    name = F.when(F.coalesce("file_url", F.lit("")) != "", F.concat(F.lit("["), X.markdown_text(F.col("name")), F.lit("]("), X.markdown_url(F.col("file_url")), F.lit(")"))) if "file_url" in files.columns else F.lit(None).cast("string")
    cells = [F.coalesce(name, F.col("name")), F.concat(F.lit("`"), F.col("location"), F.lit("`")), F.left(F.coalesce("mod_time", F.lit("")), F.lit(10))]
    cells += [F.col("provenance")] if provenance else []
    return files.agg(joined(F.col("rank"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), "\n").alias("body"))
