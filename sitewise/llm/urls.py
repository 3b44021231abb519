"""URL verdicts: path rules first, then an exact Bloom filter cascade over listed hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits that the levels of a cascade may have: what is sent to every executor stays under 128 MB.
MOST_BITS = 1 << 30

#: (verdict, host, path): a rule fits its host and all subdomains below the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Listed hosts; each stands for itself and its subdomains.
LISTED = (
    "casino-win.example.net", "free-bets.example.net", "cheap-pills.example.net", "adult-x.example.com",
    "spam-farm.example.org", "ads-track.example.com", "casino-win.example.com", "free-bets.example.com",
    "cheap-pills.example.com", "adult-x.example.org", "spam-farm.example.com", "ads-track.example.net",
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for urls without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels: int) -> list[Column]:
    """The last 1, 2, ... ``labels`` labels of a host; a host with fewer is its own suffix."""
    return [F.substring_index(host, ".", -k) for k in range(1, labels + 1)]


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def _first(rules, host: Column, path: Column, value) -> Column:
    out = None
    for r in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = _fits(host, path, r)
        out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
    return out if out is not None else F.lit(None).cast("string")


class Level:
    """One Bloom filter: a bit array, as a stored table of one row with 64-bit words, and its number of hash functions.

    An expression takes the words from the table by a scalar subquery, which runs once; no word
    passes through this process or the text of a plan.
    """

    def __init__(self, words: DataFrame, bits: int, hashes: int, seed: int):
        self.words, self.bits, self.hashes, self.seed = words, bits, hashes, seed

    @staticmethod
    def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(hashes)]

    @classmethod
    def of(cls, keys: DataFrame, n: int, rate: float, seed: int) -> Level:
        """Filter of the ``n`` keys in column ``key``; its bits are set by a distributed ``bit_or``."""
        bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64) * 64)
        if bits > MOST_BITS:
            raise ValueError(f"a level of {bits} bits for {n} keys is beyond {MOST_BITS}")
        hashes = min(max(1, round(bits / max(n, 1) * math.log(2))), 16)
        at = keys.select(F.explode(F.array(*cls.places(F.col("key"), bits, hashes, seed))).alias("at"))
        some = at.select(F.expr("at div 64").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
        none = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
        words = some.unionByName(none).groupBy("w").agg(F.bit_or("b").alias("b"))
        row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        return cls(stored(row, "level"), bits, hashes, seed)

    def has(self, key: Column) -> Column:
        words = self.words.select("words").scalar()
        test = F.lit(True)
        for at in self.places(key, self.bits, self.hashes, self.seed):
            test = test & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return test


class Cascade:
    """Exact membership in a set of listed keys, for every key of a known universe.

    Level 0 holds the listed keys; level 1 the keys of the universe that level 0 takes
    for listed by mistake; level 2 the listed keys that level 1 takes for such mistakes;
    and so on until a level makes none. A key is listed if the number of levels that hold
    it, counted from level 0 to the first that does not, is odd. There is no join, neither to
    build the levels nor to ask them: the filters are constants of one expression.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            held = self.levels[i].has(key)
            out = F.when(~held, F.lit(i % 2 == 1)).otherwise(out)
        return out

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
    """Cascade over ``universe`` (distinct, column ``key``) for ``listed`` (distinct, column ``key``).

    The false-positive rate of level 0 is r / (s * sqrt 2) for r listed and s other keys,
    of later levels one half, as published for certificate revocation: the size then grows
    with r log(s / r), not with the universe. Null keys must be filtered out before.
    An empty list gives a cascade without levels, which holds no key.
    """
    inside = stored(listed, "listed")
    r = inside.count()
    if not r:
        return Cascade([])
    # one aggregation over both sets: keys of the universe that are not listed
    both = universe.select("key", F.lit(0).alias("in")).unionByName(inside.select("key", F.lit(1).alias("in")))
    outside = stored(both.groupBy("key").agg(F.max("in").alias("in")).filter("in = 0").select("key"), "unlisted")
    s = max(1, outside.count())
    rate = min(0.5, r / (s * math.sqrt(2)))
    levels: list[Level] = []
    keys, n, other = inside, r, outside
    while n:
        if len(levels) == most_levels:
            raise RuntimeError(f"the cascade has {n} keys left after {most_levels} levels")
        level = Level.of(keys, n, rate if not levels else 0.5, seed=len(levels))
        levels.append(level)
        wrong = stored(other.filter(level.has(F.col("key"))), "wrong")
        keys, other, n = wrong, keys, wrong.count()
    return Cascade(levels)


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES) -> DataFrame:
    """Columns ``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    The longest rule that fits decides; where none fits, the cascade does: ``block`` if the
    host or a parent domain is in ``listed`` (column ``key``, host names; nulls and repeats
    are ignored), else ``allow``. ``listed`` as a result column tells the cascade's answer
    for every row. A null url, or one without ``://``, has an empty host and path, fits no
    rule and is allowed. Repeated rows give repeated results; an empty table gives none.
    """
    rows = pages.select(F.col(page_id), F.col(url).alias("__u")).select(page_id, host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path"))
    keys = listed.select("key").filter("key is not null").distinct()
    # a suffix with more labels than any listed key is not listed
    labels = keys.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 0
    host, path = F.col("host"), F.col("path")
    found = F.lit(False)
    if labels:
        hosts = rows.select("host").distinct()
        universe = hosts.select(F.explode(F.array(*suffixes(host, labels))).alias("key")).distinct()
        cascade = build_cascade(keys, universe)
        for key in suffixes(host, labels):
            found = found | cascade.has(key)
    rows = rows.withColumn("listed", found)
    return rows.select(
        page_id, "host", "path", _first(rules, host, path, lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(_first(rules, host, path, lambda r: r[0]), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
