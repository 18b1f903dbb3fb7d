"""SimHash near-duplicates with BK-trees over shards.

A fingerprint has 64 bits; a bit is 1 if more than half of the text's shingle hashes have it. Two texts link if their
fingerprints differ in ``radius`` bits at most. Distinct fingerprints are dealt into shards such that any two within the
radius meet: the bits are cut into ``BLOCKS`` blocks, and a shard is a choice of ``BLOCKS - radius`` blocks and their
values. Every shard gets a BK-tree (children keyed by the distance to their parent; a search follows only edges within
the radius of the query's own distance). Shard trees go to the queries through the shuffle rather than by a broadcast of
the driver, which would have to hold all fingerprints. Each search feeds a union-find and leaves out branches that hold
nothing but the query's own set, so a shard gives links that span its sets, and a set of near copies costs its size.

A shard of more than ``TREE_SIZE`` fingerprints is dealt into parts, twice, by different hashes. Links of these parts
give sets; then all members outside the shard's largest set meet every part (:func:`linked`), so no link is lost, and the
work grows with the square of what disagrees, not of the shard. Components of links come from :mod:`quern.llm.graph`.

:func:`near_duplicate_groups` also holds texts together that SimHash alone would miss or confuse: shards then come from
min-hash bands, and a link needs a Jaccard similarity of the shingle sets of ``least`` or more, computed exactly. Its trees
hold one bit of each of ``BITS`` min-hashes rather than SimHash bits: two of these differ with probability (1 - J) / 2
whatever the texts' lengths and repeats, so the radius has a miss rate that doesn't depend on the texts (:func:`miss_rate`).

Defined cases: a null text counts as empty; a text without words has fingerprint 0; one with fewer words than a shingle
is one shingle. Equal texts always share a group; of ties for a group's smallest document, see
:func:`without_near_duplicates`. A text of any length is hashed whole, 16,384 shingles at a time. Repeated ids and rows
are fine; an empty table gives an empty result; columns of the input pass through :func:`without_near_duplicates`
whatever their names, and :func:`near_duplicate_table` reads the id and the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.graph import components
from quern.llm.text import arrow_schema, fresh, map_rows
from quern.scratch import dropped, scope, written
from quern.session import prepared

SEED = 42
RADIUS = 2
BLOCKS = 4
#: Fingerprints of one tree, and bytes of the shingle sets beside them.
TREE_SIZE = 8192
TREE_BYTES = 16 * 1024 * 1024
#: Deals of a large shard into parts before the rest meets every part.
DEALS = 2
#: Parts of a rough group beyond which its shingle sets are compared within bands rather than in the group as a whole.
PARTS_BEFORE_BANDS = 54
#: For links by similarity: bands and rows of min-hashes (5e-10 of the pairs at similarity 0.8 don't meet), the bits of the
#: trees' keys, and their radius: bits of two texts at 0.8 differ with probability 0.1, so 4e-10 of such pairs lie beyond
#: it, and fewer above.
BANDS, ROWS, BITS, WIDE_RADIUS = 54, 5, 256, 59
MASK = (1 << 64) - 1


class BKTree:
    """A metric tree over integer keys with the Hamming distance. Nodes are numbered as they are added."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.below: list[dict[int, int]] = []

    def add(self, key: int) -> int:
        new = len(self.keys)
        if new:
            at = 0
            while True:
                d = (self.keys[at] ^ key).bit_count()
                follow = self.below[at].get(d)
                if follow is None:
                    self.below[at][d] = new
                    break
                at = follow
        self.keys.append(key)
        self.below.append({})
        return new

    def within(self, key: int, radius: int) -> list[int]:
        """Nodes at ``radius`` or less from the key."""
        if not self.keys:
            return []
        out, stack, keys, below = [], [0], self.keys, self.below
        while stack:
            at = stack.pop()
            d = (keys[at] ^ key).bit_count()
            if d <= radius:
                out.append(at)
            children = below[at]
            if children:
                low, high = d - radius, d + radius
                if len(children) > 2 * radius + 1:
                    stack += [children[e] for e in range(low, high + 1) if e in children]
                else:
                    stack += [c for e, c in children.items() if low <= e <= high]
        return out


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """XXH64 of every ``n``-word shingle of a text in lower case (A-Z), repeats included."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - n].tolist()]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[start : start + (1 << 14)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, n: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number) for every row."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = narrow.schema[0].dataType.simpleString()
    return map_rows(narrow, f"doc_id {kind}, fp long", lambda ids, texts: (ids, [signed(fingerprint(shingle_hashes(t, n))) for t in texts]))


def shard_keys(fp, radius: int = RADIUS, blocks: int = BLOCKS):
    """An array column: a number for each choice of ``blocks - radius`` blocks of the bits and their values."""
    width = 64 // blocks
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        out.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(mask)))))
    return F.array(*out)


class _Sets:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were in different sets."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def links_of(
    fps: list[int], radius: int, labels: list | None = None, sizes: list[int] | None = None, sets: list[np.ndarray] | None = None, least: float = 0.0
) -> list[tuple[int, int]]:
    """Links (row, row) that span the sets of the rows of one group, besides what equal ``labels`` hold together already.

    Two rows within the radius link; with ``sizes`` only if the smaller is at least ``least`` of the larger, with ``sets``
    only if they are similar. Every row is a query to the tree of the rows before it. A node knows a row of the set that all
    of its branch belongs to, as long as there is only one; a branch of the query's own set has no new link.
    """
    tree, sets_of, out = BKTree(), _Sets(len(fps)), []
    root, keys, below, branch = sets_of.root, tree.keys, tree.below, []
    first: dict = {}
    for i, label in enumerate(labels or ()):
        sets_of.join(i, first.setdefault(label, i))
    for i, key in enumerate(fps):
        own, stack = root(i), [0] if keys else []
        while stack:
            at = stack.pop()
            if branch[at] >= 0 and root(branch[at]) == own:
                continue
            d = (keys[at] ^ key).bit_count()
            if d <= radius and root(at) != own and (sizes is None or min(sizes[i], sizes[at]) >= least * max(sizes[i], sizes[at])) and (sets is None or _similar(sets[i], sets[at], least)):
                sets_of.join(i, at)
                own = root(i)
                out.append((i, at))
            stack += [c for e, c in below[at].items() if d - radius <= e <= d + radius]
        # as in BKTree.add: row i becomes node i; branches above it that belong to another set have two from now on
        branch.append(i)
        at, new = 0, len(keys)
        while new:
            if branch[at] >= 0 and root(branch[at]) != own:
                branch[at] = -1
            d = (keys[at] ^ key).bit_count()
            if not d and root(at) == own and (sizes is None or sizes[i] == sizes[at]) and (sets is None or np.array_equal(sets[i], sets[at])):
                break  # whatever links to this row links to that one
            follow = below[at].get(d)
            if follow is None:
                below[at][d] = new
                break
            at = follow
        keys.append(key)
        below.append({})
    return out


def _solved(rows: DataFrame, radius: int, least: float | None) -> DataFrame:
    """Links ``a, b`` of each group of rows of equal ``shard, p, o``, which one task gathers."""
    columns = ["shard", "p", "o", "vertex", "fp", *[c for c in ("label", "size", "hashes") if c in rows.columns]]
    dealt = rows.select(*columns).repartition("shard", "p", "o").sortWithinPartitions("shard", "p", "o")
    kind = rows.schema["vertex"].dataType.simpleString()
    kinds = arrow_schema(f"a {kind}, b {kind}")
    at = {c: i for i, c in enumerate(columns)}

    def solve(group: list[tuple]) -> tuple[list, list]:
        take = lambda c: [x[at[c]] for x in group] if c in at else None
        fps = [x & MASK if isinstance(x, int) else int.from_bytes(x, "little") for x in take("fp")]
        sets = take("hashes")
        sets = sets and [np.frombuffer(x, "<u8") for x in sets]
        found = links_of(fps, radius, take("label"), take("size"), sets, least or 0.0)
        return [group[i][3] for i, _ in found], [group[j][3] for _, j in found]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: tuple[list, list] = ([], [])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[:3] != group[0][:3]:
                    a, b = solve(group) if len(group) > 1 else ((), ())
                    out[0].extend(a)
                    out[1].extend(b)
                    group = []
                group.append(row)
            if len(out[0]) > 10_000:
                yield flush()
                out = ([], [])
        if len(group) > 1:
            a, b = solve(group)
            out[0].extend(a)
            out[1].extend(b)
        yield flush()

    prepared(rows.sparkSession)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _parts(n, size):
    return F.greatest(F.ceil(n / TREE_SIZE), F.ceil(size / TREE_BYTES)).cast("int")


def linked(rows: DataFrame, radius: int, least: float | None = None) -> DataFrame:
    """Links ``a, b`` that span the sets of vertices within the radius of one another in a shard. ``rows``: ``shard, vertex,
    fp``, with ``least`` also ``size`` (of the shingle set) or ``hashes`` (sorted distinct shingle hashes, as bytes) or both.

    Shards of one row have no links and are left out before anything is gathered. A shard that fits one task is one group.
    Larger ones are dealt into parts ``DEALS`` times, which finds most links; whatever isn't in the shard's largest set then
    meets every part of it, where rows that are linked already aren't compared.
    """
    weight = F.octet_length("hashes") if "hashes" in rows.columns else F.lit(0)
    count = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")).where(F.col("n") > 1)
    count = written(count.select(F.col("shard").alias("of"), _parts(F.col("n"), F.col("bytes")).alias("parts")), "shard-parts")
    known = rows.join(count, F.col("shard") == F.col("of")).drop("of")
    small = _solved(known.where(F.col("parts") == 1).withColumns({"p": F.lit(0), "o": F.lit(0)}), radius, least)
    if not count.where(F.col("parts") > 1).limit(1).count():
        return small
    large = written(known.where(F.col("parts") > 1), "large-shards")
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "vertex"), parts).cast("int")
    links = [small]
    for seed in range(DEALS):
        links.append(written(_solved(large.withColumns({"p": deal(seed, F.col("parts")), "o": F.lit(-1)}), radius, least), "links-of-parts"))
    sets = written(components(reduce(DataFrame.unionByName, links[1:])).select(F.col("vertex").alias("of"), "root"), "part-sets")
    labelled = large.join(sets, F.col("vertex") == F.col("of"), "left").withColumn("label", F.coalesce("root", "vertex")).drop("of", "root")
    labelled = written(labelled, "labelled")
    per = labelled.groupBy("shard", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes"))
    rest = per.groupBy("shard").agg(F.max(F.struct("n", "bytes", "label")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") > F.col("main.n"))
    rest = rest.select(F.col("shard").alias("of"), F.col("main.label").alias("main"), _parts(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others"))
    rest = written(rest, "shard-rest")
    here = labelled.join(rest, F.col("shard") == F.col("of")).drop("of")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = here.withColumn("p", deal(DEALS, F.col("parts"))).withColumn("o", upto(F.col("others")))
    others = here.where(F.col("label") != F.col("main")).withColumn("o", deal(DEALS + 1, F.col("others"))).withColumn("p", upto(F.col("parts")))
    links.append(_solved(every.unionByName(others), radius, least))
    return reduce(DataFrame.unionByName, links)


def near_duplicate_table(docs: DataFrame, n: int = 3, radius: int = RADIUS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; a component's id is its smallest document id."""
    fps = written(fingerprints(docs, n, text, id_col), "simhash")
    with scope() as keep:
        named = keep(_named_fingerprints(fps, radius))
    return fps.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _named_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """``of, component_id`` of every distinct fingerprint."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = written(distinct, "simhash-distinct")
    keyed = distinct.select(F.explode(shard_keys(F.col("fp"), radius, radius + 2)).alias("shard"), F.col("fp").alias("vertex"), "fp")
    edges = written(linked(keyed, radius), "simhash-links")
    groups = written(components(edges), "simhash-groups")
    named = distinct.join(groups, F.col("fp") == F.col("vertex"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(named.join(least, "root").select(F.col("fp").alias("of"), "component_id"), "simhash-named")


def _multipliers(k: int) -> np.ndarray:
    """Odd multipliers of the min-hashes, from a fixed seed."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(hashes: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The least value of the hashes under each of ``k`` mixes; all bits set without hashes."""
    least = np.full(k, MASK, np.uint64)
    mult = _multipliers(k)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 128):
            part = hashes[start : start + 128, None] * mult[None, :]
            part ^= part >> np.uint64(29)
            part *= np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum(least, part.min(axis=0))
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A number for each band of ``rows`` min-hashes. Equal sets have equal keys; so have two empty ones."""
    import xxhash

    keys = least.reshape(bands, rows)
    return [signed(xxhash.xxh64_intdigest(keys[b].tobytes(), b)) for b in range(bands)]


def min_hash_bits(least: np.ndarray) -> bytes:
    """A mixed bit of each of the first ``BITS`` min-hashes. Equal min-hashes have equal bits, others in half of all cases."""
    with np.errstate(over="ignore"):
        mixed = (least[:BITS] ^ (least[:BITS] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return np.packbits((mixed >> np.uint64(63)).astype(bool), bitorder="little").tobytes()


def miss_rate(similarity: float, radius: int = WIDE_RADIUS) -> float:
    """The share of pairs of that Jaccard similarity whose :func:`min_hash_bits` differ in more than ``radius`` bits."""
    p = (1 - similarity) / 2
    return sum(comb(BITS, k) * p**k * (1 - p) ** (BITS - k) for k in range(radius + 1, BITS + 1))


def sketches(docs: DataFrame, n: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``digest, doc_id, fp, size, bands`` of every row: a digest of its text, its min-hash bits, the number of its distinct
    shingles and its band keys."""
    t = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(bytearray(b"")))
    narrow = docs.select(_digest(t).alias("digest"), F.col(f"`{id_col}`").alias("doc_id"), t.alias("text"))

    def sketch(digests, ids, bodies):
        fps, sizes, bands = [], [], []
        for x in bodies:
            hashes = np.unique(shingle_hashes(x, n))
            least = min_hashes(hashes)
            fps.append(min_hash_bits(least))
            sizes.append(len(hashes))
            bands.append(band_keys(least))
        return digests, ids, fps, sizes, bands

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_rows(narrow, f"digest binary, doc_id {kind}, fp binary, size int, bands array<long>", sketch)


def _digest(binary):
    return F.unhex(F.md5(binary))


def near_duplicate_groups(docs: DataFrame, n: int = 5, least: float = 0.8, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct texts (``digest, doc_id``: its smallest id), ``vertex, root`` of those that have a similar other one, and
    ``digest, doc_id`` of the rows that are there several times.

    First, min-hash bits and band keys of each text; keys that one text alone has go at once, before more than the key and
    the text's digest is shuffled. Trees over a band's shard link texts within the wide radius and of similar size; the
    components of these links are the candidates. Then the shingle sets of candidates alone are compared exactly where the
    trees bring them together: within their component, or, of a component that would be too many parts, within its bands.
    """
    each = written(sketches(docs, n, text, id_col), "sketches")
    several = written(each.groupBy("digest", "doc_id").count().where(F.col("count") > 1).drop("count"), "repeated-rows")
    first = each.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("s"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")])
    first = written(first.select("digest", "s.doc_id", "fp", "size", "bands"), "distinct-texts")
    dropped(each)
    keyed = first.select(F.explode("bands").alias("shard"), F.col("digest").alias("vertex"))
    shared = written(keyed.groupBy("shard").count().where(F.col("count") > 1).select(F.col("shard").alias("of")), "shared-bands")
    meeting = written(keyed.join(shared, F.col("shard") == F.col("of")).drop("of"), "meeting")
    sketch = first.select(F.col("digest").alias("of"), "fp", "size")
    with scope() as keep:
        rough = linked(meeting.join(sketch, F.col("vertex") == F.col("of")).drop("of"), WIDE_RADIUS, least)
        rough = keep(written(components(written(rough, "rough-links")), "rough-groups"))
    dropped(meeting)
    known = rough.join(first, F.col("vertex") == F.col("digest"))
    parts = written(known.groupBy("root").agg(_parts(F.count(F.lit(1)), 8 * F.sum("size")).alias("parts")).select(F.col("root").alias("of"), "parts"), "group-parts")
    where = F.when(F.col("parts") <= PARTS_BEFORE_BANDS, F.array(F.xxhash64("root"))).otherwise(F.col("bands"))
    place = known.join(parts, F.col("root") == F.col("of")).select(where.alias("shards"), F.col("digest").alias("of"), F.col("doc_id").alias("of_id"), "fp")
    t = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(bytearray(b"")))
    bodies = docs.select(_digest(t).alias("digest"), F.col(f"`{id_col}`").alias("id"), t.alias("text"))
    members = bodies.join(place, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("of_id"))).select("shards", "digest", "fp", "text")

    def sets(shards, digests, fps, bodies):
        return shards, digests, fps, [np.unique(shingle_hashes(x, n)).astype("<u8").tobytes() for x in bodies]

    with_sets = written(map_rows(members, "shards array<long>, vertex binary, fp binary, hashes binary", sets), "shingle-sets")
    dealt = with_sets.select(F.explode("shards").alias("shard"), "vertex", "fp", "hashes")
    return first.select("digest", "doc_id"), components(written(linked(dealt, WIDE_RADIUS, least), "links")), several


def without_near_duplicates(docs: DataFrame, n: int = 5, least: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of texts that are equal or linked by similarity, with the columns of ``docs``.

    The row with the smallest id stays (null first; then the smallest digest); of rows equal in both, one.
    """
    with scope() as keep:
        first, groups, several = near_duplicate_groups(docs, n, least, text, id_col)
        named = first.join(groups, F.col("digest") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "digest"))
        stays = named.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("s")).select(F.col("s.digest").alias("of"), F.col("s.doc_id").alias("of_id"))
        stays = keep(written(stays, "stays"))
        keep(several)
    digest, doc, row = fresh(docs, "digest", "id", "row")
    t = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(bytearray(b"")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), _digest(t).alias(digest), F.col(f"`{id_col}`").alias(doc))
    here = (F.col(digest) == F.col("of")) & F.col(doc).eqNullSafe(F.col("of_id"))
    if not several.limit(1).count():
        return keyed.join(stays, here).select(f"{row}.*")
    twice = several.select(F.col("digest").alias("__d"), F.col("doc_id").alias("__i"))
    same = (F.col("of") == F.col("__d")) & F.col("of_id").eqNullSafe(F.col("__i"))
    kept = keyed.join(stays.join(twice, same, "left_anti"), here).select(f"{row}.*")
    return kept.unionByName(keyed.join(stays.join(twice, same, "left_semi"), here).dropDuplicates([digest, doc]).select(f"{row}.*"))
