"""The indexing run: from a listing to chunks, vectors and the manifest, with an outcome for every file.

Listed files are compared with the manifest; those to do are parsed, chunked and embedded in Arrow batches, one file at a
time; every one of them then loses its old chunks and has its new ones, and its row of the manifest says what became of it.
Files that the listing no longer has go from all tables. The manifest is a keyed table (:func:`manifest.save_keyed`), chunks lie
in buckets of their root by file (:mod:`quern.operators.points`): a run rewrites the buckets of the files it touches, and
running it again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import chunking, manifest, points, providers
from quern.scratch import written
from quern.session import prepared
from quern.sources import parsers

MANIFEST = "file_id string, name string, path string, root string, size long, mod_time string, status string, error string, n_chunks long, seq long, name_key string, path_key string"
POINTS = "point_id string, file_id string, idx long, root string, text string, page int, section string, label string, citation string, content_hash string, vector array<float>"


@dataclass(frozen=True)
class Run:
    counts: DataFrame
    outcomes: DataFrame


def named(files: DataFrame) -> DataFrame:
    """With the NFKC forms of name and path, which :func:`catalog.score_documents` reads."""
    return files.withColumns({"name_key": X.normalize(F.col("name"), True), "path_key": X.normalize(F.col("path"), True)})


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def stored(spark: SparkSession, at: str, ddl: str) -> DataFrame:
    """A keyed table, or an empty one where there is none."""
    return manifest.read_keyed(spark, at) if manifest.versions(spark, at) else _empty(spark, ddl)


def plan(listed: DataFrame, known: DataFrame, retry_failed: bool = False, force: bool = False) -> DataFrame:
    """``listed`` with ``kind``, ``skip`` (why it isn't to be indexed) and ``change`` (null: not to be touched)."""
    kind = X.category(F.col("name"))
    with_kind = listed.withColumn("kind", kind).withColumn("skip", X.skip_reason(F.col("name"), kind))
    return manifest.needs_index(with_kind, known, retry_failed, force)


def chunks_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of rows of ``file_id, name, content``, and ``file_id, error`` of every one of them."""
    parsed = written(parsers.parse_files(files), "parsed")
    pieces = chunking.chunk_files(parsed.where(F.col("error").isNull()))
    return written(pieces, "pieces"), parsed.select("file_id", "error")


def run(
    spark: SparkSession, listed: DataFrame, contents: DataFrame, path: str, retry_failed: bool = False, force: bool = False, roots: list[str] | None = None, verify: bool = False
) -> Run:
    """One run. ``listed``: ``file_id, name, path, root, size, mod_time``; ``contents``: ``file_id, content``; the tables are
    ``manifest`` and ``points`` below ``path``. Only files of ``roots``, if given, are missed when the listing lacks them.
    ``verify`` looks for files that lack chunks that the manifest counts, after a run that broke off, and indexes them again.
    """
    prepared(spark)
    known = stored(spark, f"{path}/manifest", MANIFEST)
    todo = plan(listed, known, retry_failed, force)
    if verify:
        lost = points.incomplete(points.read(spark, f"{path}/points", POINTS), known).select(F.col("file_id").alias("lost"))
        todo = todo.join(lost, F.col("file_id") == F.col("lost"), "left").withColumn("change", F.coalesce("change", F.when(F.col("lost").isNotNull(), "lost"))).drop("lost")
    todo = written(todo, "run-plan")
    wanted = todo.where(F.col("change").isNotNull() & F.col("skip").isNull())
    found = wanted.select("file_id", "name").join(contents.select("file_id", "content"), "file_id", "left")
    bare = F.when(F.col("content").isNull(), "failed: no content").when(F.octet_length("content") == 0, "skipped: empty file")
    found = found.withColumn("bare", bare)
    pieces, errors = chunks_of(found.where(F.col("bare").isNull()).select("file_id", "name", "content"))
    facts = wanted.select("file_id", "name", "root")
    cited = X.citation(F.col("name"), F.col("page"), F.col("section"), F.col("label"))
    fresh = pieces.join(facts, "file_id").select(
        X.uuid5(F.concat_ws(":", "file_id", F.col("idx").cast("string"))).alias("point_id"), "file_id", "idx", "root", "text", "page", "section", "label", cited.alias("citation"),
        F.sha2("text", 256).alias("content_hash"), providers.embed(F.concat_ws("\n", cited, "text")).alias("vector"),
    )
    fresh = written(fresh, "run-points")
    n = fresh.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    told = errors.unionByName(found.where(F.col("bare").isNotNull()).select("file_id", F.col("bare").alias("error")))
    result = todo.join(told.select(F.col("file_id").alias("of"), "error"), F.col("file_id") == F.col("of"), "left").drop("of").join(n, "file_id", "left")
    old = known.select(F.col("file_id").alias("of"), F.col("status").alias("was"), F.col("error").alias("said"), F.col("n_chunks").alias("had"))
    result = result.join(old, F.col("file_id") == F.col("of"), "left")
    reason = F.coalesce("skip", "error", F.when(F.col("n").isNull(), "skipped: no text"))
    status = F.when(F.col("skip").isNotNull(), "skipped").when(F.col("change").isNull(), F.col("was")).when(F.col("n") > 0, "indexed").when(F.col("error").startswith("failed"), "failed").otherwise("skipped")
    result = result.select(
        "file_id", "name", "path", "root", "size", "mod_time", status.alias("status"),
        F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("change").isNull(), F.col("said")).when(status == "indexed", F.lit(None)).otherwise(reason).alias("error"),
        F.when(F.col("change").isNull(), F.col("had")).when(status == "indexed", F.col("n")).otherwise(0).cast("long").alias("n_chunks"),
        F.when(F.col("skip").isNotNull() & ~F.col("was").eqNullSafe("skipped"), F.coalesce("change", F.lit("skip"))).when(F.col("skip").isNull(), F.col("change")).alias("change"),
        F.xxhash64("file_id").alias("seq"),
    )
    outcomes = written(named(result), "run-outcomes")
    here = known if roots is None else known.where(F.col("root").isin(roots))
    gone = written(manifest.deleted(here, listed).select("file_id"), "run-gone")
    changed = outcomes.where(F.col("change").isNotNull())
    moved = known.join(changed.select("file_id").unionByName(gone).distinct(), "file_id", "left_semi").where(F.col("n_chunks") > 0)
    _one_length(spark, f"{path}/points", fresh)
    points.replace(spark, f"{path}/points", fresh, moved.select("file_id", "root"), POINTS)
    manifest.save_keyed(spark, f"{path}/manifest", changed.select(*[c.split()[0] for c in MANIFEST.split(", ")]), ["file_id"], deleted=gone)
    return Run(manifest.run_counts(outcomes), outcomes)


def _one_length(spark: SparkSession, at: str, fresh: DataFrame) -> None:
    """All vectors of a table have one length."""
    dim = fresh.select(F.size("vector").alias("n")).distinct().limit(2).collect()
    had = points.read(spark, at, POINTS).select(F.size("vector").alias("n")).limit(1).collect()
    if len(dim) > 1 or (dim and had and dim[0]["n"] != had[0]["n"]):
        raise ValueError(f"vectors of {[r['n'] for r in dim]} numbers for a table of {[r['n'] for r in had]}")


def remove_root(spark: SparkSession, path: str, root: str) -> int:
    """Takes a root out of the manifest and the chunk table; returns the number of its files."""
    known = stored(spark, f"{path}/manifest", MANIFEST)
    ids = written(known.where(F.col("root") == root).select("file_id"), "root-files")
    points.remove_root(spark, f"{path}/points", root)
    manifest.save_keyed(spark, f"{path}/manifest", known.limit(0), ["file_id"], deleted=ids)
    return ids.count()
