"""Exact URL lists as cascades of Bloom filters, in DataFrame functions only.

Level 0 encodes the listed keys. Keys of the corpus that pass it without being listed, its false
positives over the complete universe of the corpus's keys, are encoded by level 1; the
listed keys that level 1 takes for those are encoded by level 2, and so on until a level has no false
positives. A key is listed if the first level that rejects it has an odd number, so membership is exact for
every key of the universe and judging a URL needs no join.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.scratch import cut, drop

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    rest = _rest(url)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The keys as a table with a column key, made by the JVM from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


class Level:
    """A Bloom filter of `bits` bits and `hashes` hash functions. Its bytes are one binary literal of the plan, however many they are."""

    def __init__(self, number: int, bits: int, hashes: int):
        self.number, self.bits, self.hashes, self.set = number, bits, hashes, bytearray(bits // 8)

    def positions(self, key: Column) -> list[Column]:
        # the level comes first, as the seed of the key's hash: keys that one level confuses are told apart by another
        return [F.pmod(F.xxhash64(F.lit(f"{self.number}:{i}"), key), F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
        for word, bits in words.collect():  # at most bits / 64 rows: the filter itself
            self.set[8 * word : 8 * word + 8] = bits.to_bytes(8, "little", signed=True)
        return self

    def has(self, key: Column) -> Column:
        stored = F.lit(self.set)

        def bit(p: Column) -> Column:
            byte = F.substring(stored, F.floor(p / 8).cast("int") + 1, F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (p % 8).cast("int")) == 1

        return reduce(Column.__and__, map(bit, self.positions(key)))


class Cascade:
    """Exact membership of a list of keys, of any length, among all keys of a universe."""

    def __init__(self, listed: list[str], universe: DataFrame):
        """universe: a written table with a column key, each key once."""
        self.levels: list[Level] = []
        inside = sorted(set(listed))
        if not inside:
            return
        encoded, tested, n = _listed(universe.sparkSession, inside), universe, len(inside)
        # bits enough that level 0 has about as many false positives as there are keys
        hashes = max(3, math.ceil(math.log2(1 + universe.count() / n)))
        tables = []
        while n:  # each level confuses about an eighth of what the last one did
            level = Level(len(self.levels), 64 << max(0, math.ceil(math.log2(n * hashes * 1.44 / 64))), hashes).fill(encoded)
            self.levels.append(level)
            wrong = tested.filter(level.has(F.col("key")))
            if tested is universe:
                wrong = wrong.join(encoded, "key", "left_anti")
            wrong = cut(wrong)
            tables.append(wrong)
            encoded, tested, n, hashes = wrong, encoded, wrong.count(), 3
        drop(*tables)

    def has(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.has(key) & ~out
        return out


def _candidates(rules: list[tuple[str, str, str]]) -> Column:
    """Of a row with host, path and n_labels: the keys (host suffix + path prefix) that some rule could have."""
    keys = []
    for labels in sorted({h.count(".") + 1 for _, h, _ in rules}):
        for size in sorted({len(p) for _, _, p in rules}):
            fits = (F.col("n_labels") >= labels) & (F.length("path") >= size) & (F.col("host") != "")
            keys.append(F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, size))))
    return F.array_compact(F.array(*keys))


def _longest(keys: Column) -> Column:
    return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]


def _parsed(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("n_labels", F.length("host") - F.length(F.translate("host", ".", "")) + 1)
    return rows.withColumn("keys", _candidates(rules))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of pages (page_id, url; other columns are ignored) as page_id, host, path, rule, verdict.

    rules: (allow or block, host, path beginning with "/"). A rule fits its host and all subdomains if the path
    begins with the rule's; the longest host + path wins. Two cascades hold the
    blocked and the allowed keys; a URL in neither list is allowed. Lists may have any length: a filter is one binary literal. The distinct
    keys of the pages are written once, and levels read those. Null URLs and URLs without "://" have
    empty host and path and fit no rule; repeated rows are judged alike and stay apart, null page_ids stay; a key on both lists is blocked; very
    long URLs count whole; an empty table gives no rows.
    """
    rows = _parsed(pages, rules)
    universe = cut(rows.select(F.explode("keys").alias("key")).distinct())
    lists = {kind: Cascade([h + p for k, h, p in rules if k == kind], universe) for kind in ("block", "allow")}
    drop(universe)
    found = F.filter("keys", lambda k: lists["block"].has(k) | lists["allow"].has(k))
    rows = rows.select("page_id", "host", "path", _longest(found).alias("rule"))
    blocked = F.coalesce(lists["block"].has(F.col("rule")), F.lit(False))
    return rows.withColumn("verdict", F.when(F.col("rule").isNotNull() & blocked, "block").otherwise("allow"))
