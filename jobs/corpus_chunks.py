"""Corpus chunks: texts as pieces for a search index, with what an audit of them finds and a report for each root.

Below ``output``:

``chunks`` (Parquet, by root and language): pieces of ``size`` characters that begin every ``step``, those with fewer than
``least`` characters of text left out, secrets masked, each with a stable id and the hash of its text.

``findings`` (CSV, by root): lines with a literal credential or a private address, by file and number of the line; the text
of the line isn't in it.

``report`` (JSON, by root): files, files without a chunk, files with masked text, characters and findings, by language.

A run replaces all three, so one that failed can be run again, and one over the same texts changes nothing. Each row of the
input is a file of its own; a null text has no chunk, null roots and languages have partitions of their own. Pieces are cut
in one pass over a text, whatever its length.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, mapped, told
from quern.functions import fixed
from quern.functions import text as X
from quern.operators import manifest

DEFAULT = Path(__file__).with_suffix(".json")
CHUNKS = "chunk_id string, file_id string, idx long, n_chars long, content_hash string, text string, root string, lang string"
FINDINGS = "file_id string, line int, rule string, root string"
REPORT = "lang string, n_files long, n_empty long, n_masked long, n_chars long, n_findings long, root string"


def chunks(files: DataFrame, size: int, step: int, least: int) -> DataFrame:
    """Rows of ``CHUNKS``. A text is cut into blocks of ``step`` characters, and a piece is a block with the beginning of the next."""
    if not 0 < step <= size <= 2 * step:
        raise ValueError("a piece must reach into the next one only: step <= size <= 2 * step")
    blocks = F.regexp_extract_all(X.redact(F.col("text")), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    after = lambda i: F.left(F.coalesce(F.get("blocks", i + 1), F.lit("")), F.lit(size - step))
    piece = F.transform("blocks", lambda b, i: F.concat(b, after(i)))
    each = files.withColumn("blocks", blocks).select("file_id", "root", "lang", F.posexplode(piece).alias("idx", "text"))
    each = each.where(F.length(F.trim("text")) >= least).withColumn("idx", F.col("idx").cast("long"))
    return each.select(
        X.uuid5(F.concat_ws(":", "file_id", F.col("idx").cast("string"))).alias("chunk_id"), "file_id", "idx", F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("content_hash"), "text", "root", "lang",
    )


def findings(files: DataFrame) -> DataFrame:
    """Rows of ``FINDINGS``: the audit of every line of every text."""
    hinted = files.where(F.col("text").rlike(fixed.AUDIT_HINT))  # whatever the rules find has this
    lines = hinted.select(F.struct("file_id", "root").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return manifest.audit(lines.withColumn("line", F.col("line") + 1)).select("path.file_id", "line", "rule", "path.root")


def report(files: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Rows of ``REPORT``, from lengths alone; a file has a chunk if any of its text would be one."""
    text = F.coalesce("text", F.lit(""))
    per = files.groupBy("root", "lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.length(F.trim(text)) < least).alias("n_empty"),
        F.count_if(X.redact(text) != text).alias("n_masked"), F.sum(F.length(text)).cast("long").alias("n_chars"),
    )
    n = found.groupBy("root").agg(F.count(F.lit(1)).alias("n_findings")).select(F.col("root").alias("of"), "n_findings")
    out = per.join(n, F.col("root").eqNullSafe(F.col("of")), "left")
    return out.select("lang", "n_files", "n_empty", "n_masked", "n_chars", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), "root")


def saved(df: DataFrame, path: str, kind: str, by: list[str]) -> None:
    """Replaces a table. The hint gives files of a reasonable size and splits large partitions."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """``chunks``, ``findings`` or ``report`` of an output folder."""
    schema, kind = {"chunks": (CHUNKS, "parquet"), "findings": (FINDINGS, "csv"), "report": (REPORT, "json")}[name]
    return spark.read.schema(schema).format(kind).load(f"{output}/{name}")


def build(spark: SparkSession, source: str, output: str, settings: dict) -> dict:
    """Cuts the texts of a corpus into chunks for a search index, audits them, and reports on each root."""
    files = mapped(spark.read.format(settings["format"]).load(source), settings["columns"])
    seen = Observation()
    counted = files.observe(seen, F.count(F.lit(1)).alias("read"))
    saved(chunks(counted, settings["size"], settings["step"], settings["least"]), f"{output}/chunks", "parquet", ["root", "lang"])
    saved(findings(files), f"{output}/findings", "csv", ["root"])
    saved(report(files, table(spark, output, "findings"), settings["least"]), f"{output}/report", "json", ["root"])
    n = {name: table(spark, output, name).count() for name in ("chunks", "findings", "report")}
    return told("corpus_chunks", source=source, output=output, **seen.get, **n)


if __name__ == "__main__":
    main("corpus_chunks", DEFAULT, ("source", "output"), build)
