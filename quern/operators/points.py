"""The table of chunks and vectors, laid out for replacing and deleting files: plain Parquet in folders that Spark prunes.

Rows lie in ``root_key=<root>/n=<buckets>/bucket=<number>``: a file's chunks are in one bucket of its root, by the hash of its
id. A run reads the buckets of the files it touches and writes them again with dynamic partition overwrite, so one changed
file costs one bucket, and a search in some roots, or of some files, reads the folders of these alone. A root has buckets by
its size, a power of two of about ``ROWS`` rows each, and gets more when it has grown to ``GROWN`` times that. Spark's rebalance
gives a bucket several tasks and files if it is large.

Replacing is idempotent: a run that failed can be run again. If it fails just while Spark moves finished folders into place, a
bucket may be missing; :func:`incomplete` tells the files whose chunks aren't all there, for the next run to index again. One
run writes at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTITION = ("root_key", "n", "bucket")
LAYOUT = "root_key string, n int, bucket int"
#: Rows of a bucket of a new root, about, and how many times as many it may have before its root gets more buckets.
ROWS, GROWN = 50_000, 4
#: Touched buckets up to which their list goes to all tasks by broadcast.
MOST_BROADCAST = 100_000


def root_key(root: Column) -> Column:
    """A folder name for any root, the empty and the missing one as well."""
    return F.coalesce(F.concat(F.lit("r."), root), F.lit("none"))


def bucket(file_id: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(file_id, F.lit(""))), n).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def buckets(spark: SparkSession, path: str) -> DataFrame:
    """``root_key, n``: the roots that a table has and their numbers of buckets, from the names of folders. While a root is
    being given more buckets it has two numbers; the smaller one is complete."""
    at, fs = _fs(spark, path)
    found = list(fs.globStatus(at(f"{path}/root_key=*/n=*")) or []) if fs.exists(at(path)) else []
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    least: dict[str, int] = {}
    for f in found:
        key, n = unescape(f.getPath().getParent().getName().removeprefix("root_key=")), int(f.getPath().getName().removeprefix("n="))
        least[key] = min(n, least.get(key, n))
    return spark.createDataFrame(sorted(least.items()), "root_key string, n int")


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows with the columns of the layout."""
    kind = StructType.fromDDL(f"{schema}, {LAYOUT}")
    at, fs = _fs(spark, path)
    if not fs.exists(at(path)):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).parquet(path)
    doubled = [f.getPath().getParent() for f in (fs.globStatus(at(f"{path}/root_key=*/n=*")) or [])]
    if len({p.toString() for p in doubled}) == len(doubled):
        return rows
    return rows.join(F.broadcast(buckets(spark, path)), ["root_key", "n"], "left_semi")  # a row for each root


def read(spark: SparkSession, path: str, schema: str, roots: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """The table, or the rows of some roots or files; only their folders are read. Empty if there is none."""
    rows = _whole(spark, path, schema)
    if roots is not None:
        keys = [F.lit("none") if r is None else F.lit(f"r.{r}") for r in roots]
        rows = rows.where(F.col("root_key").isin(keys) if keys else F.lit(False))
    if files is not None:
        here = [F.col("bucket") == bucket(F.lit(f), F.col("n")) for f in files]
        rows = rows.where(reduce(lambda a, b: a | b, here, F.lit(False)) & F.col("file_id").isin(files))
    return rows.drop(*PARTITION)


def _placed(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """``df`` with the columns of the layout. ``sizes``: ``root_key, n``, a row for each root."""
    keyed = df.withColumn("root_key", root_key(F.col("root")))
    return keyed.join(F.broadcast(sizes), "root_key").withColumn("bucket", bucket(F.col("file_id"), F.col("n")))


def _power(rows: Column) -> Column:
    """The smallest power of two that gives buckets of ``ROWS`` rows at most."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(rows, F.lit(1)) / ROWS)))).cast("int")


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def replace(spark: SparkSession, path: str, new: DataFrame, files: DataFrame, schema: str) -> None:
    """The files of ``new`` (rows of ``schema``) and those of ``files`` (``file_id, root``: where they were) lose the chunks they
    had; then the table has those of ``new``. Reads and writes only the buckets that these files fall into."""
    places = files.select("file_id", "root").unionByName(new.select("file_id", "root")).distinct()
    had = buckets(spark, path)
    fresh = new.groupBy(root_key(F.col("root")).alias("root_key")).agg(_power(F.count(F.lit(1))).alias("n"))
    sizes = had.unionByName(fresh.join(had, "root_key", "left_anti"))
    gone = _placed(places, sizes)
    touched = _hint(gone.select(*PARTITION).distinct())
    old = _whole(spark, path, schema).join(touched, list(PARTITION), "left_semi")
    lost = _hint(gone.select("file_id", *PARTITION))
    kept = old.join(lost, [old[c].eqNullSafe(lost[c]) for c in ("file_id", *PARTITION)], "left_anti")
    placed = _placed(new, sizes)
    left = kept.select(*PARTITION).unionByName(placed.select(*PARTITION)).distinct()
    emptied = gone.select(*PARTITION).distinct().join(left, list(PARTITION), "left_anti").collect()  # buckets that touched files had for themselves
    columns = [f.name for f in StructType.fromDDL(f"{schema}, {LAYOUT}")]
    rows = kept.select(*columns).unionByName(placed.select(*columns))
    rows.hint("rebalance", *PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    at, fs = _fs(spark, path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in emptied:
        fs.delete(at(f"{path}/root_key={escape(r['root_key'])}/n={r['n']}/bucket={r['bucket']}"), True)
    grow(spark, path, schema, [r["root_key"] for r in gone.select("root_key").distinct().collect()])  # roots of one run


def grow(spark: SparkSession, path: str, schema: str, keys: list[str]) -> list[str]:
    """Gives those roots more buckets that have outgrown theirs; returns their keys. Counts come from the files' footers."""
    whole = _whole(spark, path, schema).where(F.col("root_key").isin(keys))
    large = whole.groupBy("root_key", "n").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > F.lit(GROWN * ROWS).cast("long") * F.col("n")).withColumn("more", _power(F.col("rows"))).collect()
    at, fs = _fs(spark, path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in large:
        rows = _whole(spark, path, schema).where((F.col("root_key") == r["root_key"]) & (F.col("n") == r["n"]))
        moved = rows.withColumn("n", F.lit(r["more"])).withColumn("bucket", bucket(F.col("file_id"), F.col("n")))
        moved.hint("rebalance", *PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
        before, away = at(f"{path}/root_key={escape(r['root_key'])}/n={r['n']}"), at(f"{path}/_gone-{uuid.uuid4().hex}")
        fs.rename(before, away)  # at once, where the file system can; readers pass over names that begin like this
        fs.delete(away, True)
    return [r["root_key"] for r in large]


def remove_root(spark: SparkSession, path: str, root: str | None) -> None:
    """Deletes a root's folder; nothing is read."""
    at, fs = _fs(spark, path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    fs.delete(at(f"{path}/root_key={escape('none' if root is None else f'r.{root}')}"), True)


def incomplete(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file_id`` of indexed files that don't have as many chunks as the manifest says, from ids and counts alone."""
    there = points.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    indexed = manifest.where(F.col("status") == "indexed").select("file_id", "n_chunks")
    return indexed.join(there, "file_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("n_chunks")).select("file_id")
