"""How filters that are applied one after the other take documents from each other: an audit by the Walsh-Hadamard transform.

A document's failures are a mask of one bit a filter. For each part and label, one aggregate takes the 32 signed parity sums of all masks:
sum s counts a document as 1, or as -1 if it fails an odd number of the filters in s. Their inverse transform is exact in integers and
gives how many documents have each mask. From those 32 cells follows what any order of the filters removes at each step, and, as a document that fails f filters
goes by each of them in 120 / f of the orders, also each filter's total over all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = 120
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 200, 50, 2
LABELS = ("n", "good", "toxic")
_GAPS = "[\\x20\\x09-\\x0D]+"
_COPY = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A few words, B few distinct ones, C capitals, D signs."""
    words = F.array_remove(F.split(text, _GAPS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * F.size(words),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS_PCT * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    mask = F.lit(0)
    for name, failing in fails.items():
        mask = mask + F.when(failing, 1 << FILTERS.index(name)).otherwise(0)
    return mask.cast("int")


def _sign(mask: Column | int, of: Column | int) -> Column:
    """1, or -1 if mask and of share an odd number of bits."""
    shared = F.bit_count((mask if isinstance(mask, Column) else F.lit(mask)).bitwiseAND(of))
    return 1 - 2 * shared.bitwiseAND(1)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of the text's own failures), and of each label the documents that are first (no copy of a smaller doc_id's text) and the rest, by text and part.

    Copies never meet: rows are counted by text and part first, which remember their least doc_id, and only those counts are compared over the parts of a text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    marked = [F.col("n"), *((F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in LABELS[1:])]
    rows = rows.select("doc_id", "part", "same", "mask", *marked)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *LABELS)))
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = rows.groupBy("same", "part", "mask").agg(*(F.sum(c).alias(c) for c in LABELS), least.alias("least"), unnamed.alias("unnamed"))
    texts = texts.withColumn("first", F.min("least.doc_id").over(W.partitionBy("same")))
    stays = F.col("least.doc_id") == F.col("first")
    first = {c: F.coalesce(F.when(stays, F.col(f"least.{c}")), F.lit(0)) + (F.col("unnamed") if c == "n" else F.lit(0)) for c in LABELS}
    return texts.select("part", "mask", *(x.alias(f"{c}_first") for c, x in first.items()), *((F.col(c) - x).alias(f"{c}_rest") for c, x in first.items()))


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, and for each label the array of its signed parity sums."""
    own = [_sign(F.col("mask"), s) for s in range(_COPY)]
    sums = []
    for c in LABELS:
        both = {1: F.col(f"{c}_first") + F.col(f"{c}_rest"), -1: F.col(f"{c}_first") - F.col(f"{c}_rest")}
        sums += [F.sum(own[s % _COPY] * both[-1 if s & _COPY else 1]).alias(f"{c}_{s}") for s in range(CELLS)]
    out = rows.groupBy("part").agg(*sums)
    return out.select("part", *(F.array(*(f"{c}_{s}" for s in range(CELLS))).alias(c) for c in LABELS))


def inverted(sums: Column) -> Column:
    """Documents of each mask from the parity sums: the transform again, divided by the number of cells, which leaves no remainder."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return F.transform(every, lambda m: F.shiftright(F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + _sign(m, s) * F.get(sums, s)), len(FILTERS)))


def _total(cells: Column, holds) -> Column:
    """Documents in the cells whose mask holds."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m), F.get(cells, m)).otherwise(F.lit(0).cast("long")))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every order of the five filters over every source.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. Null texts are empty, and copies of each other; a null source is the part ''. A row without a
    doc_id is no copy, has no copies and no labels; rows that share the least doc_id of a text are all first; a doc_id labelled twice is good, or toxic, if any of its rows says so.
    Very long texts are judged whole, in one row. A part without failures has zeros; an empty table gives no rows.
    """
    parts = parity_sums(judged(docs, labels)).select("part", *(inverted(F.col(c)).alias(c) for c in LABELS))
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", x) for x in FILTERS]
    bit, before = F.lit(0), F.lit(0)
    for i, at in enumerate(place):
        bit = bit + F.when(at == F.col("step"), 1 << i).otherwise(0)
        before = before + F.when(at < F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumn("bit", bit.cast("int")).withColumn("before", before.cast("int"))
    bit, before = F.col("bit"), F.col("before")
    has = lambda m, x: m.bitwiseAND(x) != 0
    here = lambda m: ~has(m, before) & has(m, bit)
    share = F.aggregate(F.sequence(F.lit(1), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(has(m, bit), F.get(F.col("n"), m) * F.get(F.lit([0, *(ORDERS // f for f in range(1, 6))]), F.bit_count(m))).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step",
        _total(F.col("n"), lambda m: ~has(m, before.bitwiseOR(bit))).alias("kept"),
        _total(F.col("n"), here).alias("removed"),
        _total(F.col("n"), lambda m: has(m, before) & has(m, bit)).alias("redundant"),
        F.get(F.col("n"), bit).alias("unique_fails"),
        _total(F.col("good"), here).alias("good_lost"),
        _total(F.col("toxic"), here).alias("toxic_lost"),
        share.alias("shapley"),
    )
