"""The manifest and keyed tables: what changed, what is gone, upserts and deletions, run counts, scope, audit."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed


def needs_index(listed: DataFrame, manifest: DataFrame, retry_failed: bool = False, force: bool = False) -> DataFrame:
    """``listed`` with a ``change``: new, retry, mod_time, size, forced, or null.

    Skipped files stay skipped unless forced; a size counts if it isn't negative.
    """
    old = manifest.select(F.col("file_id").alias("__id"), F.col("status").alias("__status"), F.col("mod_time").alias("__mod"), F.col("size").alias("__size"))
    j = listed.join(old, F.col("file_id") == F.col("__id"), "left")
    change = F.when(F.col("__id").isNull(), "new")
    if force:
        change = change.otherwise("forced")
    else:
        change = (
            change.when((F.col("__status") == "failed") & F.lit(retry_failed), "retry").when(F.col("__status").isin("failed", "skipped"), None)
            .when(~F.col("mod_time").eqNullSafe(F.col("__mod")), "mod_time").when((F.col("size") >= 0) & ~F.col("size").eqNullSafe(F.col("__size")), "size")
        )
    return j.withColumn("change", change).drop("__id", "__status", "__mod", "__size")


def deleted(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    return manifest.join(listed.select("file_id").distinct(), "file_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: Column | None = None) -> DataFrame:
    """Rows of ``old`` without a newer one, and of ``new`` one for each key: the largest ``newest``, else any one of equal
    keys by all columns. Old rows are dropped by an anti join, so only keys of the old table are compared."""
    order = [newest.desc()] if newest is not None else []
    order += [F.hash(*new.columns), F.xxhash64(*new.columns)]
    one = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") == 1).drop("__n")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one)


def without(table: DataFrame, ids: DataFrame, key: str = "file_id") -> DataFrame:
    """A table without the rows of some keys; no keys leave it as it is."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def replace_files(chunks: DataFrame, outcome: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The chunk table after a run: every file with any outcome loses its old chunks, indexed ones have their new ones."""
    return without(chunks, outcome).unionByName(new_chunks)


def lookup(manifest: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of some ids; the filter reaches the scan."""
    return manifest.where(F.col("file_id").isin(ids))


def all_ids(manifest: DataFrame, root: str | None = None) -> DataFrame:
    return (manifest if root is None else manifest.where(F.col("root") == root)).select("file_id").distinct()


def known_roots(files: DataFrame, listings: DataFrame) -> DataFrame:
    """Roots that have files or a listing."""
    return files.select("root").unionByName(listings.select("root")).distinct()


def has_listing(listings: DataFrame, root: str) -> bool:
    return listings.where(F.col("root") == root).limit(1).count() > 0


def listing_stats(listings: DataFrame) -> DataFrame:
    """Listings by their number of files, the largest first."""
    return listings.select("root", "n_files", "total_bytes").orderBy(F.col("n_files").desc(), "root")


def run_counts(outcomes: DataFrame) -> DataFrame:
    """One row: files by outcome, chunks, and a map of reasons. ``change``, if there, is null for files that weren't touched:
    they count as unchanged, or as still failed, or as skipped as before."""
    touched = F.col("change").isNotNull() if "change" in outcomes.columns else F.lit(True)
    reasons = outcomes.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    reasons = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("reasons"))
    is_ = lambda s: F.col("status") == s
    counts = outcomes.agg(
        F.count_if(touched & is_("indexed")).alias("indexed"), F.count_if(is_("skipped")).alias("skipped"), F.count_if(touched & is_("failed")).alias("failed"),
        F.count_if(~touched & is_("indexed")).alias("unchanged"), F.count_if(~touched & is_("failed")).alias("still_failed"),
        F.coalesce(F.sum(F.when(touched, F.col("n_chunks"))), F.lit(0)).alias("chunks"),
    )
    return counts.crossJoin(F.broadcast(reasons))


def scope_roots(scope: DataFrame, mode: str = "folders") -> DataFrame:
    """Included roots without disabled ones; an error if a root is both included and excluded. ``root, included, excluded, enabled``.

    ``mode``: ``off`` takes no root, ``all`` every one that isn't excluded or disabled, ``folders`` those that are included.
    """
    if mode not in ("off", "all", "folders"):
        raise ValueError(f"unknown mode: {mode}")
    bad = F.max(F.when(F.col("included") & F.col("excluded"), F.col("root"))).over(Window.partitionBy(F.lit(0)))
    checked = scope.withColumn("__ok", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("included and excluded: "), bad)).cast("boolean")).otherwise(True))
    wanted = {"off": F.lit(False), "all": ~F.col("excluded"), "folders": F.col("included")}[mode]
    return checked.where(F.col("__ok") & wanted & F.col("enabled")).select("root")


def fingerprint_changes(synopses: DataFrame, manifest: DataFrame, version: str) -> DataFrame:
    """Files whose synopsis is missing or was made from another time, path, root or version."""
    s = synopses.select("file_id", F.struct("mod_time", "path", "root", "version").alias("have"))
    m = manifest.where(F.col("status") == "indexed").select("file_id", F.struct("mod_time", "path", "root", F.lit(version).alias("version")).alias("want"))
    return m.join(s, "file_id", "left").where(~F.col("want").eqNullSafe(F.col("have"))).select("file_id")


def audit(lines: DataFrame) -> DataFrame:
    """``path, line, rule`` of lines with a literal credential or a private address. Input: ``path, line, text``."""
    raw = F.trim(F.regexp_extract("text", fixed.AUDIT_CREDENTIAL, 1))
    quoted = raw.rlike("^[\"']")
    value = F.when(quoted, F.regexp_extract(raw, "^([\"'])(.*?)(?:\\1|$)", 2)).otherwise(F.regexp_extract(raw, "^([^\\s\"',)}\\]]*)", 1))
    low = F.lower(value)
    forwarded = value.rlike(fixed.AUDIT_FORWARDED)
    placeholder = low.contains("<redacted>") | low.rlike(fixed.AUDIT_EXAMPLE) | value.rlike("^<.*>$") | value.rlike(r"^[A-Za-z_]\w*(?:\.\w+)*(?:[),}\]]+)?$")
    literal = F.col("text").rlike(fixed.AUDIT_CREDENTIAL) & ~forwarded & ~placeholder & (F.length(value) >= 8)
    rules = F.filter(F.array(F.when(literal, "credential"), F.when(F.col("text").rlike(fixed.AUDIT_PRIVATE_IP), "private_address")), lambda x: x.isNotNull())
    return lines.select("path", "line", F.explode(rules).alias("rule"))


#: Buckets of a small keyed table, rows of a bucket that a larger one aims at, and how many times as many it may have before
#: the table gets more buckets.
BUCKETS, BUCKET_ROWS, GROWN = 64, 200_000, 4


def _fs(spark, path: str):
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return P, P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark, path: str) -> list[int]:
    """The complete versions of a keyed table, oldest first. Each is a small file that names a folder for every bucket."""
    P, fs = _fs(spark, path)
    if not fs.exists(P(f"{path}/versions")):
        return []
    names = [s.getPath() for s in fs.listStatus(P(f"{path}/versions"))]
    return sorted(int(n.getName()[1:]) for n in names if n.getName().startswith("v") and fs.exists(P(n, "_SUCCESS")))


def _version(spark, path: str, v: int) -> tuple[dict[int, str], str, int, int]:
    """The folders of a version's buckets, the table's schema, its number of buckets and its rows."""
    lines = [r[0] for r in spark.read.text(f"{path}/versions/v{v}").collect()]  # a line for each bucket
    parts = dict(x.split("\t", 1) for x in lines)
    facts = {k: parts.pop(k, None) for k in ("schema", "buckets", "rows")}
    return {int(k): x for k, x in parts.items()}, facts["schema"], int(facts["buckets"] or BUCKETS), int(facts["rows"] or 0)


def _commit(spark, path: str, v: int, lines: list[str]) -> None:
    """Makes a version visible. Two writers that began from the same version make the same number; the second fails."""
    P, fs = _fs(spark, path)
    made = f"{path}/versions/_new-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(made)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at = P(f"{path}/versions/v{v}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:  # this rename, unlike that of a file system, fails if there is a version of this number
        context.rename(fs.makeQualified(P(made)), fs.makeQualified(at), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(P(made), True)
        raise RuntimeError(f"another writer has made version {v} of {path}") from e


def _read(spark, folders: list[str], schema: str) -> DataFrame:
    from pyspark.sql.types import StructType

    kind = StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def read_keyed(spark, path: str) -> DataFrame:
    """The newest complete version of a keyed table."""
    had = versions(spark, path)
    if not had:
        raise FileNotFoundError(path)
    folders, schema, _, _ = _version(spark, path, had[-1])
    return _read(spark, sorted(folders.values()), schema)


def save_keyed(spark, path: str, new: DataFrame, keys: list[str], newest: Column | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Upsert into a Parquet table at ``path``, and delete the keys of ``deleted``. Returns the new version.

    Rows lie in folders by the hash of their key, their number by the table's size. Only buckets that new or deleted keys fall
    into are read and written again, a large one by several tasks; when the table has outgrown its buckets all are, once. A
    version names the folder of each bucket and counts once its file is complete, so readers see the old or the new version
    whole; of two writers at once the second fails. The version before is kept; folders that neither names go.
    """
    P, fs = _fs(spark, path)
    had = versions(spark, path)
    folders, schema, n, n_rows = _version(spark, path, had[-1]) if had else ({}, new.schema.json(), 0, new.count())
    wanted = max(BUCKETS, 2 ** math.ceil(math.log2(max(1, n_rows) / BUCKET_ROWS)) if n_rows > BUCKET_ROWS else 1)
    whole = n_rows > GROWN * BUCKET_ROWS * n
    n = wanted if whole or not n else n
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    kinds = {f["name"]: f["type"] for f in json.loads(schema)["fields"]}
    new = new.select(*[F.col(c).cast(k) if isinstance(k := kinds.get(c), str) else F.col(c) for c in new.columns]).withColumn("__bucket", bucket)
    typed = [F.col(k).cast(new.schema[k].dataType).alias(k) for k in keys]  # equal keys of other types would fall into other buckets
    gone = deleted.select(*typed).distinct().withColumn("__bucket", bucket) if deleted is not None else new.select(*keys, "__bucket").limit(0)
    touched = list(range(n)) if whole else [r[0] for r in new.select("__bucket").unionByName(gone.select("__bucket")).distinct().collect()]  # buckets
    old = _read(spark, sorted(folders.values()) if whole else [folders[b] for b in touched if b in folders], schema).withColumn("__bucket", bucket).join(gone.select(*keys), keys, "left_anti")
    if deleted is not None:
        new = new.join(gone.select(*keys), keys, "left_anti")
    v = had[-1] + 1 if had else 0
    at = f"{path}/data/v{v}-{uuid.uuid4().hex}"
    upsert(old.select(*new.columns), new, keys, newest).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(at)
    now = {b: x for b, x in folders.items() if b not in touched}
    now |= {b: f"{at}/__bucket={b}" for b in touched if fs.exists(P(f"{at}/__bucket={b}"))}
    count = _read(spark, sorted(now.values()), schema).count()  # from the files' footers
    _commit(spark, path, v, [*[f"{b}\t{x}" for b, x in sorted(now.items())], f"schema\t{schema}", f"buckets\t{n}", f"rows\t{count}"])
    for before in had[:-1]:
        fs.delete(P(f"{path}/versions/v{before}"), True)
    keep = set(now.values()) | set(folders.values())
    for version in fs.listStatus(P(f"{path}/data")):
        for part in fs.listStatus(version.getPath()):
            if part.getPath().getName().startswith("__bucket=") and not any(part.getPath().toString().endswith(x.split("://")[-1]) for x in keep):
                fs.delete(part.getPath(), True)
    return _read(spark, sorted(now.values()), schema)
