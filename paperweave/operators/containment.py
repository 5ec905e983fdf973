"""Which values contain which keys, without a cross join: an index of the values' n-grams asked by each key's rarest one; or, where only the least of the holders matters, by parts of the keys' lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.sources.lineage import dropped, written

GRAM = 3
#: Values are cut where they have a character that no key has, if keys have at most so many different ones.
MOST_CHARACTERS = 2000


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters; none for a shorter text."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(values: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """values joined with the keys that they contain, of equal columns `by`. values: value, by and others; keys: key, by; both distinct. Empty keys are contained in everything and are left out here.

    A key shorter than GRAM is one gram. Of a longer one the gram asked for is the one that the fewest values have, ties to the lesser; a value that contains the key has them all, so nothing is lost. Keys with a gram that no value
    has are not joined at all. What is joined is checked by the whole key."""
    keys = keys.filter("key <> ''").select(*by, "key").distinct()
    size = F.least(F.length("key"), F.lit(GRAM))
    asked = keys.select(*by, "key", F.explode(_of_size(F.col("key"), size)).alias("gram"))
    sizes = sorted(r[0] for r in keys.select(size.alias("n")).distinct().collect())
    if not sizes:
        return values.withColumn("key", F.lit(None).cast("string")).limit(0)
    every = F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col("value"), n) for n in sizes))))).alias("gram")
    held = values.select("*", every).join(asked.select(*by, "gram").distinct(), [*by, "gram"], "left_semi")
    counts = held.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    rare = asked.join(counts, [*by, "gram"], "left").groupBy(*by, "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    rare = rare.select(*by, "key", F.col("r.gram").alias("gram"))
    return held.join(rare, [*by, "gram"]).filter(F.contains("value", "key")).drop("gram")


def _of_size(text: Column, size: Column) -> Column:
    last = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))


def parts(text: Column, n: Column | int) -> Column:
    """All runs of n characters of a text that is no shorter, in order."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.length(text) == size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def least_of_holders(rows: DataFrame, keys: DataFrame, measures: dict[str, Column], *by: str) -> list[DataFrame]:
    """Tables of by, key and the least of each measure over the rows of equal `by` that hold the key in one of their values; a key is in one table at most. rows: by, values (strings) and what measures need; keys: key, by. Strings
    that are no key may be there too. Empty keys are left out. The tables are written(); drop them once they are used.

    No pair of a row and a key is made. A value is cut to parts as long as the longest keys, equal parts become one row, and these are cut to the next shorter length, and so on: a part that holds a key of n characters has it
    in one of its own parts of any length from n on, so nothing is lost, and a length has no more rows than there are different strings of it."""
    keys = keys.filter("key <> ''")
    sizes = sorted(r[0] for r in keys.select(F.length("key")).distinct().collect())
    if not sizes:
        return []
    letters = sorted(r[0] for r in keys.select(F.explode(grams(F.col("key"), 1))).distinct().limit(MOST_CHARACTERS + 1).collect())
    runs = F.array_compact("values")
    if len(letters) <= MOST_CHARACTERS:
        gap = next(c for c in map(chr, range(10, 60000)) if c not in letters and c not in ".$|()[{^?*+\\")
        others = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]+"
        runs = F.split(F.regexp_replace(F.concat_ws(gap, "values"), others, gap), gap)
    size = lambda r: F.array_max(F.filter(F.lit(sizes), lambda n: n <= F.length(r)))
    cut = F.array_distinct(F.flatten(F.transform(F.filter(F.array_distinct(runs), lambda r: F.length(r) >= sizes[0]), lambda r: parts(r, size(r)))))
    least = [F.min(m).alias(name) for name, m in measures.items()]
    again = [F.min(name).alias(name) for name in measures]
    first = written(rows.select("*", F.explode(cut).alias("key")).groupBy(*by, "key").agg(*least))
    out: list[DataFrame] = []
    for n in reversed(sizes):
        here = first.filter(F.length("key") == n)
        if out:
            shorter = out[-1].select(*by, *measures, F.explode(F.array_distinct(parts(F.col("key"), n))).alias("key"))
            here = here.unionByName(shorter).groupBy(*by, "key").agg(*again)
        out.append(written(here))
    dropped(first)
    return out
