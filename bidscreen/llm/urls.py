"""URL filters: a Bloom filter cascade of listed hosts, and host and path rules above it.

The cascade's first level holds the listed keys; the second those of all other keys of the corpus
that the first takes for listed; the third the listed keys that the second holds by mistake, and so
on until a level takes none by mistake. Since every key of the corpus took part, membership is
exact for them. Levels are arrays of 64-bit words that reach the projection as scalar subqueries:
the table to be judged is neither joined nor shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidscreen.llm.common import ASCII_LOWER, ASCII_UPPER, materialize


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class UrlRule:
    """Fits its host and all subdomains, where the path starts with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule_columns(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does. Rules of one length go in text order."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _bit(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))


@dataclass
class Level:
    """One Bloom filter: a one-row table with the array of its words, read as a scalar subquery."""

    number: int
    bits: int
    hashes: int
    table: DataFrame

    def holds(self, key: Column) -> Column:
        words = self.table.scalar()
        out = F.lit(True)
        for j in range(self.hashes):
            at = _bit(key, self.number, j, self.bits)
            out &= F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(_power(at)) != 0
        return out


def _power(at: Column) -> Column:
    """2 to the place of a bit in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))


def build_level(keys: DataFrame, number: int, count: int, bits_per_key: int, hashes: int) -> Level:
    """The Bloom filter of keys.key."""
    words = max(1, ceil(count * bits_per_key / 64))
    at = F.explode(F.array(*[_bit(F.col("key"), number, j, words * 64) for j in range(hashes)]))
    of_word = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_power(F.col("at"))).alias("bits"))
    dense = keys.sparkSession.range(words).join(of_word, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])
    return Level(number, words * 64, hashes, materialize(dense.agg(ordered.alias("words")), "bloom"))


def cascade(universe: DataFrame, bits_per_key: int = 12, hashes: int = 6) -> list[Level]:
    """The levels for universe(key, listed): one row for each key of the corpus."""
    levels: list[Level] = []
    inside, outside = universe.where("listed"), universe.where("NOT listed")
    while n := inside.count():
        level = build_level(inside, len(levels), n, bits_per_key, hashes)
        levels.append(level)
        mistaken = materialize(outside.where(level.holds(F.col("key"))), "mistaken")
        inside, outside = mistaken, inside
    return levels


def group_count(universe: DataFrame, max_bits: int, bits_per_key: int = 12, hashes: int = 6) -> int:
    """Into how many groups of keys a cascade has to be parted, so that one group's levels take about max_bits at most."""
    n = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    wrong = (1 - exp(-hashes / bits_per_key)) ** hashes
    first, second = n.get(True, 0), n.get(False, 0) * wrong
    return max(1, ceil(bits_per_key * (first + second) / (1 - wrong) / max_bits)) if first else 1


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that lacks it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.holds(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


#: The column that says in which folder a row is.
_GROUP = "_group_of_hosts"


def by_group(df: DataFrame, name: str) -> DataFrame:
    """df written with a folder for each group, so that a filter by group reads that folder alone. Rows of one group go to
    several tasks, by a hash of the row (maps have none): a group, or a host, may hold a third of all rows."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if c != _GROUP and "map<" not in kind]), F.lit(16))
    return materialize(df.repartition(_GROUP, salt), name, (_GROUP,))


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: list[UrlRule], url_col: str = "url", max_bits: int = 1 << 27) -> DataFrame:
    """pages with host, path, rule and verdict; columns of pages with these names are replaced.

    The longest rule that fits decides; where none fits, pages of hosts in listed_hosts(host) are
    blocked and all others allowed. A url that is null or lacks :// has an empty host and path,
    which no rule fits and which is never listed. Repeated rows are judged alike; listed hosts
    that are null, empty, repeated or absent from pages have no effect. The cascade is exact since
    its universe is every host of pages. Hosts are parted by hash into as many groups as keep one
    group's levels at about max_bits. More than one group: pages are dealt to a folder for each once, and groups
    are judged one after another, each over its own folder by a cascade of its own, and written, so that no task ever
    holds more than one group's levels and pages are read twice, however many groups there are.
    """
    parted = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    hosts = parted.where("host != ''").groupBy(F.col("host").alias("key")).agg(F.lit(0).alias("_"))
    marks = listed_hosts.select(F.col("host").alias("key")).where("key IS NOT NULL").distinct().withColumn("m", F.lit(True))
    universe = materialize(hosts.join(marks, "key", "left").select("key", F.coalesce("m", F.lit(False)).alias("listed")), "hosts")
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    groups = group_count(universe, max_bits)

    def judged(part: DataFrame, levels: list[Level]) -> DataFrame:
        method = F.when((F.col("host") != "") & listed(levels, F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
        return part.withColumns({"rule": text, "verdict": F.coalesce(verdict, method)})

    if groups == 1:
        return judged(parted, cascade(universe))
    deal = lambda df, c, name: by_group(df.withColumn(_GROUP, F.pmod(F.xxhash64(F.col(c), F.lit("group")), F.lit(groups)).cast("int")), name)
    dealt, keys = deal(parted, "host", "pages"), deal(universe, "key", "keys")
    own = lambda df, g: df.where(F.col(_GROUP) == g).drop(_GROUP)
    return reduce(DataFrame.unionByName, [materialize(judged(own(dealt, g), cascade(own(keys, g))), "judged") for g in range(groups)])
