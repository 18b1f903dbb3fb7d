"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups can be as many as texts, so differencing doesn't see each of them. A group of at least ``1 / (shards * FINE)`` of
all bytes is an item of its own: there are ``shards * FINE`` of those at most. All smaller groups fall into ``BUNDLES``
bundles by the hash of their text, and each bundle is an item. The driver thus differences a number of items that doesn't
grow with the input, and rows find their shard by two small broadcast tables of that bound.

Differencing: every item starts as a partial partition (its bytes and zeros). The two partial partitions with the largest
spread are combined again and again, the largest shard of one with the smallest of the other.

Defined cases: a null text has no bytes and CRC 0 and is a group of its own; a row's size is its bytes plus ``PER_ROW``,
and a text of any length is read once, for its bytes, CRC and digest. Equal texts share a shard, even where one group
outweighs a fair share; items of equal bytes are differenced in the order of their digests. Repeated rows get slots of their
own. An empty table gives an empty result. Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import written

PER_ROW = 8
FINE = 32
BUNDLES = 4096


def differenced(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by k-way differencing. Ties go by the order of the items, so reruns agree."""
    if not sizes:
        return []
    seq = count()
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for i, size in enumerate(sizes):
        sums: list[tuple[int, list]] = [(size, [i])] + [(0, [])] * (parts - 1)
        heapq.heappush(heap, (-size, next(seq), sums))
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # members are trees of pairs, so that joining two parts costs one step however many items they hold
        both = [(x[0] + y[0], [x[1], y[1]] if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b), strict=True)]
        both.sort(key=lambda x: -x[0])
        low = both[-1][0]
        heapq.heappush(heap, (-(both[0][0] - low), next(seq), both))
    out = [0] * len(sizes)
    for part, (_, members) in enumerate(heap[0][2]):
        stack = [members]
        while stack:
            for x in stack.pop():
                if isinstance(x, list):
                    stack.append(x)
                else:
                    out[x] = part
    return out


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + PER_ROW).cast("long")


def text_crc(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def with_shard(rows: DataFrame, size: str, group: str, shards: int, out: str = "shard") -> DataFrame:
    """``rows`` with the shard of their group. ``group`` is a binary digest without nulls; two passes over the narrow rows."""
    spark = rows.sparkSession
    groups = rows.groupBy(group).agg(F.sum(size).cast("long").alias("bytes"))
    groups = written(groups, "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // (shards * FINE)))
    bundle = lambda g: F.pmod(F.xxhash64(g), F.lit(BUNDLES)).cast("int")
    large = groups.where(F.col("bytes") >= least).collect()  # shards * FINE at most, since their bytes add up to total
    small = groups.where(F.col("bytes") < least).groupBy(bundle(F.col(group)).alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    items = sorted([(-r["bytes"], 0, bytes(r[group]), None) for r in large] + [(-r["bytes"], 1, b"", r["bundle"]) for r in small])
    part = differenced([-x[0] for x in items], shards)
    of_large = [(bytearray(x[2]), p) for x, p in zip(items, part, strict=True) if x[1] == 0]
    of_small = [(x[3], p) for x, p in zip(items, part, strict=True) if x[1] == 1]
    a = spark.createDataFrame(of_large, "__g binary, __p int")
    b = spark.createDataFrame(of_small, "__b int, __q int")
    return (
        rows.join(F.broadcast(a), F.col(group) == F.col("__g"), "left")
        .join(F.broadcast(b), bundle(F.col(group)) == F.col("__b"), "left")
        .withColumn(out, F.coalesce("__p", "__q"))
        .drop("__g", "__p", "__b", "__q")
    )


def with_slot(rows: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """``rows`` with a gapless number from 0 in each shard.

    Rows are numbered within the partitions they lie in and start where the partitions before end, so no task holds a whole
    shard, nor all rows that are equal.
    """
    placed = written(rows.withColumn("__run", F.spark_partition_id()), "shard-runs")
    counts = placed.groupBy(shard, "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select(F.col(shard).alias("__s"), F.col("__run").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = Window.partitionBy(shard, "__run").orderBy(*order)
    numbered = placed.withColumn("__k", F.row_number().over(at) - 1)
    joined = numbered.join(starts, (F.col(shard) == F.col("__s")) & (F.col("__run") == F.col("__r")))
    return joined.withColumn(out, (F.col("__start") + F.col("__k")).cast("long")).drop("__run", "__k", "__s", "__r", "__start")


def sharded(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; the law is ``bytes``."""
    t = F.col(f"`{text}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text_size(t).alias("size"), text_crc(t).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(t.cast("binary"))), F.lit(bytearray(b"null"))).alias("__group"),
    )
    narrow = written(narrow, "shard-rows")
    placed = with_shard(narrow, "size", "__group", shards).drop("__group")
    out = with_slot(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
