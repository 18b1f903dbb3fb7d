"""URL filtering by rules and by a cascade of Bloom filters, built from DataFrame functions only.

The cascade answers "is this key listed?" exactly for every key of a universe that was known when it was built. Level 1
holds the listed keys, level 2 the unlisted keys of the universe that level 1 lets through, level 3 the listed keys that
level 2 lets through, and so on until nothing passes by mistake. A key is listed if the first level that rejects it is an
even one (or if all levels pass it and their number is odd). Levels are bit arrays in the expression itself, so testing a
URL needs no join; which of the universe's keys are listed comes from one aggregation.

The bits of a cascade reach the driver and every task. They are bounded by ``MAX_BYTES``: keys are counted first, and where
one cascade would be larger, keys and rows are dealt by a hash of the key into as many shards as are needed; each shard has
a cascade of its own, and only one of them is in the driver at a time (:func:`with_listed`).

Defined cases: a null URL or one without ``://`` has an empty host and path; no rule fits it and it is allowed unless the
empty host is listed. A null key is never listed. A URL of any length is read whole. Repeated rows get equal verdicts; of
rules that fit, the longest decides, and of equally long ones the later by code point; an empty table, an empty list and an
empty universe are fine. Other columns take no part, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import fresh
from quern.scratch import written

#: Bits of all levels of one cascade, at most; with more keys there are several.
MAX_BYTES = 1024 * 1024
#: False positives of level 1, and of each level after it.
FIRST_RATE, NEXT_RATE = 1 / 64, 1 / 8
MAX_LEVELS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules. Listed are hosts with any of these labels, and addresses of pages with so many runs
#: of symbols.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SYMBOL_RUN, MOST_RUNS = "[#*$%]{3}", 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    rest = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    """The rule's host or a subdomain of it, and a path that begins with the rule's."""
    _, at, start = rule
    return ((host == at) | host.endswith("." + at)) & path.startswith(start)


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = rule_fits(host, path, rule)
        name = F.when(fits, F.lit(rule[1] + rule[2])).otherwise(name)
        verdict = F.when(fits, F.lit(rule[0])).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant when planned
        at = F.array(*places(key, len(self.words), self.hashes, self.seed))
        return F.forall(at, lambda p: F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)


def places(key: Column, n_words: int, hashes: int, seed: int) -> list[Column]:
    """Bit places of a key: two hashes, combined as first + i * second."""
    first = F.xxhash64(key, F.lit(2 * seed)).bitwiseAND(0x3FFFFFFFFFFFFF)
    second = F.xxhash64(key, F.lit(2 * seed + 1)).bitwiseAND(0x3FFFFFFFFFFFF)
    return [F.pmod(first + second * i, F.lit(64 * n_words).cast("bigint")) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed. Later levels are read only where earlier ones pass."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[k - 1].has(key), F.lit(k % 2 == 0)).otherwise(out)
        return out

    @property
    def n_bytes(self) -> int:
        return sum(8 * len(x.words) for x in self.levels)


def known_keys(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """``key, listed`` for every distinct key of both, null left out. Both have the key as their only column."""
    both = listed.toDF("key").withColumn("listed", F.lit(True)).unionByName(universe.toDF("key").withColumn("listed", F.lit(False)))
    return both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"))


def _level_words(n: int, first: bool) -> tuple[int, int]:
    """Words and hashes of a level for ``n`` keys."""
    hashes = max(1, round(-math.log2(FIRST_RATE if first else NEXT_RATE)))
    return max(1, math.ceil(n * hashes / math.log(2) / 64)), hashes


def expected_bytes(n_listed: int, n_other: int) -> int:
    """The bits of a cascade, as bytes: each level lets a known share of the keys through that the next one holds."""
    out, here, there, first = 0, float(n_listed), float(n_other), True
    while here >= 1 or first:
        out += 8 * _level_words(math.ceil(here), first)[0]
        here, there, first = there * (FIRST_RATE if first else NEXT_RATE), here, False
    return out


def build_cascade(keys: DataFrame) -> Cascade:
    """A cascade of ``key, listed`` (see :func:`known_keys`), a table that is read once or twice for each level: for a count
    and an aggregation of the keys that still pass."""
    here, there = keys.where("listed"), keys.where("NOT listed")
    levels: list[Level] = []
    while (n := here.count()) or not levels:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade doesn't end")
        n_words, hashes = _level_words(n, not levels)
        seed = len(levels)
        bits = here.select(F.explode(F.array(*places(F.col("key"), n_words, hashes, seed))).alias("at"))
        rows = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits")
        ).collect()  # n_words rows at most
        words = [0] * n_words
        for r in rows:
            words[r["word"]] = r["bits"]
        levels.append(Level(tuple(words), hashes, seed))
        here, there = there.where(levels[-1].has(F.col("key"))), here
    return Cascade(tuple(levels))


def with_listed(df: DataFrame, key: str, listed: DataFrame, out: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with a boolean ``out``: its key is among the keys (first column) of ``listed``.

    With keys for one cascade it is part of the plan. With more, rows are written by shard, and shard by shard read with the
    shard's cascade and written again; nothing is shuffled.
    """
    at = F.col(f"`{key}`")
    keys = written(known_keys(listed.select(F.col(f"`{listed.columns[0]}`")), df.select(at)), "url-keys")
    n = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    shards = max(1, math.ceil(expected_bytes(n[0], n[1]) / max_bytes))
    test = lambda c: F.coalesce(c.listed(at), F.lit(False))
    if shards == 1:
        return df.withColumn(out, test(build_cascade(keys)))
    (shard,) = fresh(df, "shard")
    place = lambda c: F.coalesce(F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(shards)), F.lit(0)).cast("int")
    dealt = written(df.withColumn(shard, place(at)), "url-rows", by=[shard])
    keys = written(keys.withColumn(shard, place(F.col("key"))), "url-shards", by=[shard])
    done = [
        written(dealt.where(F.col(shard) == s).drop(shard).withColumn(out, test(build_cascade(keys.where(F.col(shard) == s)))), "url-shard")
        for s in range(shards)
    ]
    return reduce(DataFrame.unionByName, done)


def hosts_with_label(hosts: DataFrame, labels: Sequence[str] = LISTED_LABELS) -> DataFrame:
    """The hosts (column ``key``) that have one of the labels between their dots."""
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in labels])))


def addresses_of_junk(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``key``: host and path of pages with more than ``MOST_RUNS`` runs of symbols."""
    runs = F.coalesce(F.regexp_count(F.col(f"`{html}`"), F.lit(SYMBOL_RUN)), F.lit(0))
    u = F.col(f"`{url}`")
    return pages.where(runs > MOST_RUNS).select(F.concat(url_host(u), url_path(u)).alias("key")).distinct()


def judged_urls(
    pages: DataFrame, hosts: DataFrame | None = None, addresses: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
    url: str = "url", id_col: str = "page_id", html: str = "html", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row. A page is blocked if its host is among ``hosts`` or its host and
    path, joined, among ``addresses``; by default hosts with a listed label and addresses of junk pages (of a table without
    HTML: none). Hosts and addresses have a cascade each."""
    u = F.col(f"`{url}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"))
    if hosts is None:
        hosts = hosts_with_label(parts.select(F.col("host").alias("key")).distinct())
    if addresses is None:
        addresses = addresses_of_junk(pages, url, html) if html in pages.columns else hosts.limit(0)
    parts = with_listed(parts, "host", hosts, "__hit", max_bytes)
    parts = with_listed(parts.withColumn("__address", F.concat("host", "path")), "__address", addresses, "__hit_too", max_bytes)
    name, verdict = by_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("__hit") | F.col("__hit_too"), F.lit("block")).otherwise(F.lit("allow"))
    return parts.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
