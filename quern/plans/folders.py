"""Queries of folder aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import folders, manifest
from quern.plans.base import CHUNKS, FILES, chunks, files, query, rows


@query("files_in_root", FILES + "SELECT root, name, max(mod_time) AS mod_time FROM files GROUP BY 1, 2")
def files_in_root(spark, d):
    return folders.files_in_root(files(spark, d))


@query("subfolders_in_root", FILES + "SELECT root, split_part(path, '/', 1) AS folder, count(DISTINCT file_id) AS n_files, max(mod_time) AS mod_time FROM files GROUP BY 1, 2")
def subfolders_in_root(spark, d):
    return folders.subfolders(files(spark, d))


@query("dominant_root", FILES + """, h AS (SELECT root, row_number() OVER (ORDER BY size DESC, seq) AS rank FROM files QUALIFY rank <= 15)
SELECT root, round(sum(1.0::DOUBLE / rank), 4) AS total FROM h GROUP BY root ORDER BY sum(1.0::DOUBLE / rank) DESC, min(rank) LIMIT 1""")
def dominant_root(spark, d):
    from quern.operators.fusion import with_rank

    f = files(spark, d)
    top = f.orderBy(F.col("size").desc(), "seq").limit(50)
    hits = with_rank(top, "rank", F.col("size").desc(), F.col("seq")).withColumn("score", F.lit(1.0) / F.col("rank"))
    return folders.dominant_root(hits).select("root", F.round("total", 4).alias("total"))


@query("latest_file_in_root", FILES + "SELECT root, max(mod_time) AS mod_time, arg_max(file_id, mod_time || '|' || file_id) AS file_id FROM files GROUP BY root")
def latest_file_in_root(spark, d):
    return folders.latest_file(files(spark, d)).select("root", "mod_time", "file_id")


@query("most_recent_chunks", CHUNKS + f""", f AS ({FILES} SELECT * FROM files), best AS (SELECT root, arg_max(file_id, mod_time || '|' || file_id) AS file_id FROM f GROUP BY root)
SELECT root, file_id, idx, 0.0::DOUBLE AS score FROM chunks WHERE file_id IN (SELECT file_id FROM best) AND idx < 6""")
def most_recent_chunks(spark, d):
    """The first six chunks of each root's latest file, with score 0."""
    best = folders.latest_file(files(spark, d)).select("file_id")
    return chunks(spark, d).where(F.col("idx") < 6).join(best, "file_id", "left_semi").select("root", "file_id", "idx", F.lit(0.0).alias("score"))


@query("chunks_of_file", CHUNKS + "SELECT file_id, idx, sha256(text) AS h FROM chunks WHERE file_id = '7' ORDER BY idx LIMIT 3")
def chunks_of_file(spark, d):
    return chunks(spark, d).where(F.col("file_id") == "7").orderBy("idx").limit(3).select("file_id", "idx", F.sha2("text", 256).alias("h"))


@query("status_summary", FILES + "SELECT status, count(*) AS n_files, CAST(coalesce(sum(n_chunks), 0) AS BIGINT) AS n_chunks FROM files GROUP BY 1")
def status_summary(spark, d):
    return folders.status_summary(files(spark, d))


@query("root_summary", FILES + "SELECT root, count(*) AS n_files, CAST(sum(n_chunks) AS BIGINT) AS n_chunks FROM files WHERE status = 'indexed' GROUP BY 1 ORDER BY 3 DESC")
def root_summary(spark, d):
    f = files(spark, d).where(F.col("status") == "indexed")
    return f.groupBy("root").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chunks").alias("n_chunks")).orderBy(F.col("n_chunks").desc(), "root")


@query("reason_histogram", FILES + """, c AS (SELECT error, count(*) AS n FROM files WHERE error IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, error) AS k FROM c)
SELECT CASE WHEN k <= 4 THEN error ELSE '(other)' END AS reason, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def reason_histogram(spark, d):
    """The commonest reasons and the remainder in one row."""
    from quern.operators.fusion import with_rank

    counts = files(spark, d).where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_rank(counts, "k", F.col("n").desc(), F.col("error"))
    return ranked.groupBy(F.when(F.col("k") <= 4, F.col("error")).otherwise("(other)").alias("reason")).agg(F.sum("n").alias("n"))


@query("ext_histogram", FILES + "SELECT lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def ext_histogram(spark, d):
    return files(spark, d).groupBy(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("corpus_scan", FILES + "SELECT root, split_part(path, '/', 1) AS folder, status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY GROUPING SETS ((root), (root, folder), (status), ())")
def corpus_scan(spark, d):
    """Counts and bytes by root, by root and folder, by status and in all, in one aggregation."""
    f = files(spark, d).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1)))
    sets = f.groupingSets([["root"], ["root", "folder"], ["status"], []], "root", "folder", "status")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("chunk_estimate", FILES + "SELECT CAST(sum(CASE WHEN name LIKE '%.pdf' THEN size // 1000 WHEN status = 'indexed' THEN 3 ELSE 0 END) AS BIGINT) AS chunks FROM files")
def chunk_estimate(spark, d):
    per = F.when(F.col("name").endswith(".pdf"), F.floor(F.col("size") / 1000)).when(F.col("status") == "indexed", 3).otherwise(0)
    return files(spark, d).agg(F.sum(per).cast("long").alias("chunks"))


LISTING_SQL = FILES + r""", f AS (SELECT root, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, lower(regexp_extract(name, '(\.[^.]*)$', 1)) AS ext, name, greatest(size, 0) AS bytes FROM files),
f2 AS (SELECT root, directory, ext, name, bytes FROM f UNION ALL SELECT root, NULL, ext, name, bytes FROM f),
t AS (SELECT root, directory, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM f2 GROUP BY 1, 2),
e AS (SELECT root, directory, ext, count(*) AS n FROM f2 GROUP BY 1, 2, 3), e2 AS (SELECT *, row_number() OVER (PARTITION BY root, directory ORDER BY n DESC, ext) AS k FROM e),
e3 AS (SELECT root, directory, string_agg(ext || 'x' || n, ', ' ORDER BY k) AS endings FROM e2 WHERE k <= 6 GROUP BY 1, 2),
n AS (SELECT root, directory, name, row_number() OVER (PARTITION BY root, directory ORDER BY name) AS k FROM f2), n2 AS (SELECT root, directory, string_agg(name, ', ' ORDER BY name) AS samples FROM n WHERE k <= 8 GROUP BY 1, 2)
SELECT t.root, t.directory, n_files, total_bytes, endings, samples FROM t JOIN e3 ON t.root = e3.root AND t.directory IS NOT DISTINCT FROM e3.directory JOIN n2 ON t.root = n2.root AND t.directory IS NOT DISTINCT FROM n2.directory"""


@query("listing_rollup", LISTING_SQL)
def listing_rollup(spark, d):
    return folders.listing_rollup(files(spark, d))


@query("listing_text", LISTING_SQL.replace("SELECT t.root, t.directory, n_files, total_bytes, endings, samples FROM", "SELECT t.root, coalesce(t.directory, '(all)') AS directory, t.root || ': ' || n_files || ' files; ' || endings || '; ' || samples AS text FROM"))
def listing_text(spark, d):
    """One chunk of text for each root and directory."""
    r = folders.listing_rollup(files(spark, d))
    text = F.concat("root", F.lit(": "), F.col("n_files").cast("string"), F.lit(" files; "), "endings", F.lit("; "), "samples")
    return r.select("root", F.coalesce("directory", F.lit("(all)")).alias("directory"), text.alias("text"))


@query("listing_ids", FILES + "SELECT root, count(*) AS n FROM files GROUP BY 1")
def listing_ids(spark, d):
    """How many listing points a root's directories would have: ids depend on root and directory, not on an index."""
    f = files(spark, d).withColumn("point", X.uuid5(F.concat_ws(":", F.lit("listing"), "root", "path")))
    return f.groupBy("root").agg(F.countDistinct("point").alias("n"))


@query("folder_names", FILES + "SELECT root, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT root, name, row_number() OVER (PARTITION BY root ORDER BY name) AS k FROM (SELECT DISTINCT root, name FROM files)) WHERE k <= 300 GROUP BY 1")
def folder_names(spark, d):
    """Every folder's file list as one row; 300 names are shown at most."""
    from pyspark.sql import Window

    f = folders.files_in_root(files(spark, d))
    f = f.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("name"))).where(F.col("k") <= 300)
    return f.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


@query("known_roots", FILES + "SELECT DISTINCT root FROM files UNION SELECT 'lab/empty'")
def known_roots(spark, d):
    return manifest.known_roots(files(spark, d), rows(spark, "root string", ("lab/empty",), ("lab/src1",)))


@query("manifest_lookup", FILES + "SELECT file_id, name, status FROM files WHERE file_id IN ('3', '17', '99', 'gone')")
def manifest_lookup(spark, d):
    return manifest.lookup(files(spark, d), ["3", "17", "99", "gone"]).select("file_id", "name", "status")


@query("listing_stats", LISTING_SQL.replace("SELECT t.root, t.directory, n_files, total_bytes, endings, samples FROM", "SELECT t.root, n_files, total_bytes FROM") + " WHERE t.directory IS NULL ORDER BY n_files DESC, t.root")
def listing_stats(spark, d):
    return manifest.listing_stats(folders.listing_rollup(files(spark, d)).where(F.col("directory").isNull()))


@query("recent_in_dominant_root", CHUNKS + f""", f AS ({FILES} SELECT * FROM files), h AS (SELECT root, row_number() OVER (ORDER BY size DESC, seq) AS rank FROM f QUALIFY rank <= 15),
r AS (SELECT root FROM h GROUP BY root ORDER BY sum(1.0::DOUBLE / rank) DESC, min(rank) LIMIT 1), best AS (SELECT arg_max(file_id, mod_time || '|' || file_id) AS file_id FROM f WHERE root IN (SELECT root FROM r))
SELECT file_id, idx FROM chunks WHERE file_id IN (SELECT file_id FROM best) AND idx < 6""")
def recent_in_dominant_root(spark, d):
    """The root that most of the best hits lie in, and the first chunks of its latest file."""
    from quern.operators.fusion import with_rank

    f = files(spark, d)
    top = with_rank(f.orderBy(F.col("size").desc(), "seq").limit(50), "rank", F.col("size").desc(), F.col("seq")).withColumn("score", F.lit(1.0) / F.col("rank"))
    return folders.most_recent(top, f, chunks(spark, d)).select("file_id", "idx")


FOLDERS = (("r", "root", [], False), ("a", "A", ["r"], False), ("b", "B", ["a"], False), ("x", "X", ["y"], False), ("y", "Y", ["x"], False), ("t", "T", ["r"], True), ("m", "M", ["x", "b"], False))
ITEMS = (("i1", "one", ["r"]), ("i2", "two", ["b"]), ("i3", "three", ["o"]), ("i4", "four", ["x"]), ("i5", "five", ["t"]), ("i6", "six", ["m"]), ("i7", "seven", []))


@query("ancestry_paths", "SELECT * FROM (VALUES ('i1', true, 'one'), ('i2', true, 'A/B/two'), ('i3', false, NULL), ('i4', false, NULL), ('i5', false, NULL), ('i6', true, 'A/B/M/six'), ('i7', false, NULL)) t(item_id, inside, path)")
def ancestry_paths(spark, d):
    """A direct child, two levels, outside, a cycle, a trashed folder, several parents and none."""
    f = rows(spark, "id string, name string, parents array<string>, trashed boolean", *FOLDERS)
    return folders.ancestry(spark, rows(spark, "id string, name string, parents array<string>", *ITEMS), f, "r")
