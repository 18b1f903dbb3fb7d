"""Aggregates over the manifest: folders, listings, status, and the recursion over folder parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def files_in_root(files: DataFrame) -> DataFrame:
    """Per root and file name the latest time: files of equal name count once."""
    return files.groupBy("root", "name").agg(F.max("mod_time").alias("mod_time"))


def subfolders(files: DataFrame) -> DataFrame:
    """Per root and first level of the path the distinct files and the latest time; files at the top are ``(root)``."""
    level = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("(root)")
    return files.groupBy("root", level.alias("folder")).agg(F.countDistinct("file_id").alias("n_files"), F.max("mod_time").alias("mod_time"))


def dominant_root(hits: DataFrame, votes: int = 15) -> DataFrame:
    """The root whose rows among the first ``votes`` have the largest sum of scores; of equal ones the first seen."""
    few = hits.where((F.col("rank") <= votes) & (F.col("root") != ""))
    return few.groupBy("root").agg(F.sum("score").alias("total"), F.min("rank").alias("first")).orderBy(F.col("total").desc(), "first").limit(1)


def latest_file(files: DataFrame) -> DataFrame:
    """Per root the file with the largest time; a missing time counts as the empty string, ties go to the largest id."""
    best = F.max(F.struct(F.coalesce("mod_time", F.lit("")).alias("mod_time"), F.col("file_id"), F.col("name")))
    return files.groupBy("root").agg(best.alias("b")).select("root", "b.mod_time", "b.file_id", "b.name")


def most_recent(hits: DataFrame, files: DataFrame, chunks: DataFrame, most: int = 6) -> DataFrame:
    """The first chunks of the latest file of the hits' dominant root; none if the hits name no root."""
    root = F.broadcast(dominant_root(hits).select("root"))  # one row
    best = latest_file(files.join(root, "root", "left_semi")).select("file_id")
    return chunks.where(F.col("idx") < most).join(F.broadcast(best), "file_id", "left_semi")


def status_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"))


def listing_rollup(files: DataFrame, extensions: int = 6, samples: int = 8, directories: int = 15) -> DataFrame:
    """Per root the whole of it (``directory`` null) and its largest directories: files, bytes, commonest endings, names.

    One grouping-sets aggregation gives the totals; endings are counted before they are ranked and collected, so an array
    holds a few entries however many files there are. Sample names are the smallest ones, taken by a rank filter.
    """
    f = files.withColumns({
        "directory": F.regexp_extract("path", "^(.*)/[^/]*$", 1),
        "ext": F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)),
        "bytes": F.greatest("size", F.lit(0)),
    })
    both = lambda df, *more: df.groupingSets([["root", "directory", *more], ["root", *more]], "root", "directory", *more)
    totals = both(f).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("total_bytes"))
    exts = both(f, "ext").agg(F.count(F.lit(1)).alias("n"))
    by_n = Window.partitionBy("root", "directory").orderBy(F.col("n").desc(), "ext")
    exts = exts.withColumn("k", F.row_number().over(by_n)).where(F.col("k") <= extensions)
    exts = exts.groupBy("root", "directory").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ext", "n"))), lambda x: F.concat(x["ext"], F.lit("x"), x["n"].cast("string"))), ", ").alias("endings"))
    names = f.select("root", "directory", "name").unionByName(f.select("root", F.lit(None).cast("string").alias("directory"), "name"))
    names = names.withColumn("k", F.row_number().over(Window.partitionBy("root", "directory").orderBy("name"))).where(F.col("k") <= samples)
    names = names.groupBy("root", "directory").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("samples"))
    side = lambda df, c: df.select(F.col("root").alias(f"__r_{c}"), F.col("directory").alias(f"__d_{c}"), c)
    same = lambda c: F.col("root").eqNullSafe(F.col(f"__r_{c}")) & F.col("directory").eqNullSafe(F.col(f"__d_{c}"))
    out = totals.join(side(exts, "endings"), same("endings")).join(side(names, "samples"), same("samples"))
    out = out.select("root", "directory", "n_files", "total_bytes", "endings", "samples")
    largest = F.row_number().over(Window.partitionBy("root", F.col("directory").isNull()).orderBy(F.col("n_files").desc(), "directory"))
    return out.withColumn("k", largest).where(F.col("directory").isNull() | (F.col("k") <= directories)).drop("k")


def ancestry(spark, items: DataFrame, folders: DataFrame, root_id: str, depth: int = 64) -> DataFrame:
    """``item_id, inside, path`` for each item: whether one of its chains of parents reaches the root.

    A recursion over the folder table that carries the visited ids, so a cycle ends; of several paths the first by
    length and then by name is given. ``items`` and ``folders``: ``id, name, parents`` (array); trashed folders block.
    """
    items.select("id", "name", "parents").createOrReplaceTempView("__anc_items")
    folders.where(~F.coalesce("trashed", F.lit(False))).select("id", "name", "parents").createOrReplaceTempView("__anc_folders")
    found = spark.sql(
        f"""WITH RECURSIVE up (item, at, path, seen, n) MAX RECURSION LEVEL {depth} AS (
              SELECT id, explode(parents), name, array(id), 0 FROM __anc_items
              UNION ALL
              SELECT item, p, concat(name, '/', path), array_append(seen, at), n + 1
              FROM (SELECT u.item, u.at, u.path, u.seen, u.n, f.name, explode(f.parents) AS p FROM up u JOIN __anc_folders f ON u.at = f.id
                    WHERE u.at <> '{root_id}' AND NOT array_contains(u.seen, u.at) AND u.n < {depth - 2}))
            SELECT item, min(struct(n, path)) AS best FROM up WHERE at = '{root_id}' GROUP BY item"""
    )
    joined = items.select(F.col("id").alias("item_id")).join(found, F.col("item_id") == F.col("item"), "left")
    return joined.select("item_id", F.col("item").isNotNull().alias("inside"), F.col("best.path").alias("path"))
