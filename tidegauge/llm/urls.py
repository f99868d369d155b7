"""URL filters: exact membership in key lists by a Bloom filter cascade.

The first level encodes the listed keys.  The second encodes those keys of the
corpus that the first takes for listed though they are not, the third those
listed keys that the second takes for such, and so on until a level makes no
error.  As the levels are built over all keys of the corpus, the answer for any
of them is exact, and asking is an expression on the row: no join.

All on DataFrame functions.  A level is one byte for each slot in a binary
literal; a list of over ``SHARD_KEYS`` keys is cut into shards of bounded
size, which are asked in passes over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import let, written

#: Listed keys in one cascade at most; its levels then hold under 8 MB together.
SHARD_KEYS = 1 << 18
SLOTS, HASHES = 16, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the production query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = ("casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains; none for an empty host."""
    return let(F.split(host, r"\."), lambda p: F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes with the path's beginnings of the given lengths: all keys under which a rule can fit."""
    starts = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array(F.lit(""))
    return F.flatten(F.transform(host_suffixes(host), lambda s: F.transform(F.filter(starts, lambda x: x.isNotNull()), lambda x: F.concat(s, x))))


@dataclass(frozen=True)
class Cascade:
    """Levels of one shard, each with its salt in its place."""

    levels: tuple[bytes, ...]

    def has(self, key: Column) -> Column:
        """Whether the key is listed; exact for all keys that the cascade was built over."""
        out = F.lit(False)
        for k in reversed(range(len(self.levels))):
            out = _in_level(key, self.levels[k], k) & ~out if k < len(self.levels) - 1 else _in_level(key, self.levels[k], k)
        return out


def _slots(key: Column, size: int, level: int) -> Column:
    h1, h2 = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    step = F.pmod(h2, F.lit(size))
    return let(F.struct(F.pmod(h1, F.lit(size)).alias("a"), step.alias("b")), lambda x: F.array(*[F.pmod(x["a"] + F.lit(j) * x["b"], F.lit(size)).cast("int") for j in range(HASHES)]))


def _in_level(key: Column, level: bytes, k: int) -> Column:
    bits = F.lit(bytearray(level))
    return F.forall(_slots(key, len(level), k), lambda p: F.substring(bits, p + 1, F.lit(1)) == F.lit(bytearray(b"\x01")))


def _level(keys: DataFrame, n: int, k: int) -> bytes:
    size = max(64, SLOTS * n)
    out = bytearray(size)
    for r in keys.select(F.explode(_slots(F.col("key"), size, k)).alias("p")).distinct().collect():
        out[r[0]] = 1  # at most HASHES * SHARD_KEYS places
    return bytes(out)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def build_cascades(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """A cascade for each shard of the listed keys (column ``key``), exact over the universe's keys."""
    listed = listed.where("key IS NOT NULL").select("key").distinct()
    shards = max(1, -(-listed.count() // SHARD_KEYS))
    out = []
    for s in range(shards):
        mine, other = listed.where(_shard(F.col("key"), shards) == s), universe.where(_shard(F.col("key"), shards) == s)
        n, levels = mine.count(), []
        a, b = mine, other.join(mine, "key", "left_anti")
        while n:
            levels.append(_level(a, n, len(levels)))
            b = b.where(_in_level(F.col("key"), levels[-1], len(levels) - 1))
            a, b, n = b, a, b.count()
        out.append(Cascade(tuple(levels) or (bytes(64),)))
    return out


def listed_keys(rows: DataFrame, keys: str, into: str, cascades: list[Cascade]) -> DataFrame:
    """Adds the listed ones among an array of keys; more than one shard takes a pass each, cut by a table in the shared folder."""


    def asked(s: int, cascade: Cascade):
        return lambda k: (_shard(k, len(cascades)) == s) & cascade.has(k) if len(cascades) > 1 else cascade.has(k)

    for s, c in enumerate(cascades):
        found = F.filter(keys, asked(s, c))
        rows = rows.withColumn(into, F.concat(into, found) if s else found)
        if len(cascades) > 1:
            rows = written(rows, "url-pass")
    return rows


def filter_urls(pages: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, blocked: DataFrame | tuple[str, ...] = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, listed (whether the host or a parent domain is on the blocked list).

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins, of equals one that blocks.  Where none fits, the
    verdict is ``block`` for a listed host and ``allow`` for all others, an
    empty host (null, no ``://``) among them.  Repeated rows stay.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    lengths = sorted({len(p) for _, p, _ in rules})
    rows = base.withColumns({"keys": rule_keys(F.col("host"), F.col("path"), lengths), "hosts": host_suffixes(F.col("host"))})
    sites = base.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()
    universe = sites.select(F.explode(F.array_union(rule_keys(F.col("host"), F.col("path"), lengths), host_suffixes(F.col("host")))).alias("key")).distinct()
    universe = written(universe, "url-keys")
    for name, verdict in (("allow", "allow"), ("block", "block")):
        keys = [h + p for h, p, v in rules if v == verdict]
        rows = listed_keys(rows, "keys", name, build_cascades(_keys(spark, keys), universe))
    names = _keys(spark, list(blocked)) if isinstance(blocked, tuple) else blocked.toDF("key")
    rows = listed_keys(rows, "hosts", "names", build_cascades(names, universe))
    longest = lambda c: F.array_max(F.transform(c, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key"))))
    rows = rows.withColumns({"allow": longest("allow"), "block": longest("block")})
    allows = F.col("allow").isNotNull() & (F.col("block").isNull() | (F.col("allow.n") > F.col("block.n")))
    listed = F.size("names") > 0
    return rows.select(
        "page_id",
        "host",
        "path",
        F.when(allows, F.col("allow.key")).otherwise(F.col("block.key")).alias("rule"),
        F.when(allows, "allow").when(F.col("block").isNotNull() | listed, "block").otherwise("allow").alias("verdict"),
        listed.alias("listed"),
    )


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"))
