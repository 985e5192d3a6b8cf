"""URL filters by Bloom filter cascades.

Level 0 encodes the listed keys. Keys of the corpus that pass it without being
listed are encoded by level 1, the listed keys that pass level 1 by level 2, and
so on until a level lets nothing wrong through. A key of the corpus is then
listed exactly if it first fails at an odd level, or passes all of an odd number
of levels. No join decides membership: a filter is a constant of the plan.

The list is a table of any length. Keys are dealt by hash into as many slices as
keep at most SLICE_KEYS listed keys each; a slice has a cascade of its own (level
0 is sized so that about as many other keys pass as are listed, so a slice's filters
stay below about a megabyte), and a key asks that of its slice. At most PASS_SLICES
cascades are in one plan; more take further passes over the rows.

A rule is a host and a path. Keys of a URL are its host suffixes joined with the
prefixes of its path, of the lengths that rules have.

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stored

#: Listed keys of a slice, and slices whose filters one plan holds.
SLICE_KEYS, PASS_SLICES = 100_000, 8
MAX_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Names of listed hosts (a name under any of the zones); a URL that no rule fits is blocked if its host is one or below one.
LISTED_NAMES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
ZONES = ("example.com", "example.net", "example.org")
LISTED_HOSTS = tuple(f"{n}.{z}" for n in LISTED_NAMES for z in ZONES)


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    body: bytes
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        if not self.bits:
            return F.lit(False)
        out = F.lit(True)
        body = F.lit(self.body)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(body, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.get(F.array(*(F.lit(1 << b) for b in range(8))), (at % 8).cast("int")).bitwiseAND(byte) != 0)
        return out


def build_bloom(keys: DataFrame, count: int, bits_per_key: float, seed: int) -> Bloom:
    """A filter of the column ``key``; its words of 64 bits are aggregated on the executors."""
    if not count:
        return Bloom(0, 0, b"", seed)
    bits = 64 * math.ceil(max(64, count * bits_per_key) / 64)
    empty = Bloom(bits, max(1, round(bits_per_key * math.log(2))), b"", seed)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("flags"))
    body = bytearray(bits // 8)
    for r in rows.toLocalIterator():  # at most bits / 64 rows, bounded by the keys of a slice
        body[8 * r["word"] : 8 * r["word"] + 8] = (r["flags"] % (1 << 64)).to_bytes(8, "little")
    return Bloom(bits, empty.hashes, bytes(body), seed)


@dataclass(frozen=True)
class Cascade:
    """Levels of one slice of the keys."""

    levels: tuple[Bloom, ...]
    slice: int = 0
    slices: int = 1

    def listed(self, key: Column) -> Column:
        """Exact for keys of the universe it was built over; null keys and keys of other slices are not listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[depth].has(key), out).otherwise(F.lit(depth % 2 == 1))
        return key.isNotNull() & (_slice(key, self.slices) == self.slice) & out


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(slices)).cast("int") if slices > 1 else F.lit(0)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 1, place: tuple[int, int] = (0, 1)) -> Cascade:
    """One slice's cascade from its listed keys and the universe (both: key) of all keys that will be asked; repeated and null keys do no harm."""
    inside = listed.where("key IS NOT NULL").distinct()
    others = universe.where("key IS NOT NULL")
    names = inside.count()
    if not names:
        return Cascade((), *place)
    distinct = max(1, others.agg(F.approx_count_distinct("key")).first()[0])
    per_key = 1.44 * math.log2(max(4.0, 1.5 * distinct / names))
    levels = [build_bloom(inside, names, per_key, seed * MAX_LEVELS)]
    # what passes level 0 is about as many keys as are listed, however large the universe is; the listed ones among them go by an aggregate
    passing = others.where(levels[0].has(F.col("key"))).select("key", F.lit(0).alias("own")).unionByName(inside.select("key", F.lit(1).alias("own")))
    outside = stored(passing.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"), "cascade")
    sides, count = [inside, outside], [names, outside.count()]
    while count[len(levels) % 2]:
        depth = len(levels)
        if depth >= MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(build_bloom(sides[depth % 2], count[depth % 2], 1.44 * 2, seed * MAX_LEVELS + depth))
        # those of the other side that pass go to the next level
        other = (depth + 1) % 2
        sides[other] = sides[other].where(levels[-1].has(F.col("key")))
        count[other] = sides[other].count()
    return Cascade(tuple(levels), *place)


def build_cascades(listed: DataFrame, universe: DataFrame, seed: int = 1) -> Iterator[list[Cascade]]:
    """Cascades of all slices, PASS_SLICES at a time, so that only those are held."""
    slices = max(1, -(-listed.select(F.count_distinct("key")).first()[0] // SLICE_KEYS))
    if slices == 1:
        yield [build_cascade(listed, universe, seed)]
        return
    placed = [stored(side.where("key IS NOT NULL").select("key", _slice(F.col("key"), slices).alias("slice")), "slices", "slice") for side in (listed, universe)]
    for first in range(0, slices, PASS_SLICES):
        part = range(first, min(slices, first + PASS_SLICES))
        yield [build_cascade(*(side.where(F.col("slice") == k).select("key") for side in placed), seed, (k, slices)) for k in part]


def _asked(cascades: Sequence[Cascade]) -> Callable[[Column], Column]:
    """Whether one of the cascades lists a key."""

    def asked(key: Column) -> Column:
        out = F.lit(False)
        for c in cascades:
            out = out | c.listed(key)
        return out

    return asked


def _host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column, labels: Sequence[int]) -> Column:
    """Suffixes of a host with these numbers of labels, as far as it has so many."""
    parts = F.split(host, r"\.")
    found = [F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.lit(-n), F.lit(n)), ".")) for n in sorted(set(labels))]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def listed_table(spark: SparkSession, hosts: Sequence[str] = LISTED_HOSTS) -> DataFrame:
    """A short list of hosts as the table (key) that judge_urls takes."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, hosts)).cast("array<string>")).alias("key"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages (page_id, url, ...).

    The longest fitting rule wins (of equal ones, that of the longer host, then the
    later key by code point); without one the URL is blocked if a suffix of its host
    is in the table listed (key; of any length; null keys and repeats do no harm),
    else allowed. A null URL, or one without ``://``, has an empty host and path,
    fits no rule and is allowed. A very long URL is judged whole. Repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    listed = listed_table(spark) if listed is None else listed.select(F.col("key").cast("string").alias("key"))
    host, path = _host_and_path(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = [r.host.count(".") + 1 for r in rules]
    lengths = sorted({len(r.path) for r in rules})
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths)))
    keys = F.flatten(
        F.transform(_suffixes(F.col("host"), labels), lambda h: F.transform(prefixes, lambda x: F.struct(F.concat(h, x).alias("key"), F.length(h).alias("host"))))
    )
    sizes = [r[0] for r in listed.where("key IS NOT NULL").select(F.regexp_count("key", F.lit(r"\.")).alias("n")).distinct().collect()]  # numbers of labels of a host: a few
    keyed = urls.withColumn("keys", keys).withColumn("hosts", _suffixes(F.col("host"), [n + 1 for n in sizes]))
    rule_keys = keyed.select(F.explode("keys.key").alias("key"))
    host_keys = keyed.select(F.explode("hosts").alias("key"))
    named = lambda action: listed_table(spark, [r.key for r in rules if r.action == action])
    block, allow = build_cascade(named("block"), rule_keys, 1), build_cascade(named("allow"), rule_keys, 2)

    def fitting(k: Column) -> Column:
        action = F.when(block.listed(k["key"]), "block").when(allow.listed(k["key"]), "allow")
        return F.struct(F.length(k["key"]).alias("length"), k["host"].alias("host"), k["key"].alias("key"), action.alias("action"))

    best = F.array_max(F.filter(F.transform("keys", fitting), lambda x: x["action"].isNotNull()))
    out = keyed.select("page_id", "host", "path", "hosts", best.alias("best")).withColumn("bad", F.lit(False))
    for number, cascades in enumerate(build_cascades(listed, host_keys, 3)):
        if number:  # a pass of its own
            out = stored(out, "judged")
        out = out.withColumn("bad", F.col("bad") | F.exists("hosts", _asked(cascades)))
    other = F.when(F.col("bad"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.action"), other).alias("verdict"))


def op6_bloom_cascade(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    fits = ",\n  ".join(f"('{r.key}', '{r.action}', '{r.host}', '{r.path}')" for r in RULES)
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)
    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
urls AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(key, action, rhost, rpath) AS (VALUES {fits}),
fit AS (SELECT u.*, r.key, r.action, r.rhost FROM urls u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC NULLS LAST, length(rhost) DESC) AS n FROM fit)
SELECT page_id, host, path, key AS rule, coalesce(action, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict FROM best WHERE n = 1
"""


OP6_SQL = _oracle()
