"""Sharding by a hierarchical weighted hash tree.

A topology lists shards with their region, rack and weight. A key descends it: among the
regions, then the chosen region's racks, then that rack's shards, it takes the child with
the least value of -ln(u) / weight, where u is a uniform draw from a hash of the key and the
child's name and a node's weight is the sum of its shards' weights. A key so reaches each shard in
proportion to its weight, and a change of weights moves keys only into subtrees that gained weight
or out of those that lost it: the draws of all others stay as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.llm.scratch import cut, salt

SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, base: int = 8) -> list[Shard]:
    """Up to `base` shards in racks of two and regions of two racks; every further shard opens a region of
    its own. Growing by one shard beyond `base` so adds one new subtree and changes no other weight, and
    the only keys that move are those which the new shard draws."""
    return [Shard(i, i // 4, i // 2) if i < base else Shard(i, 1000 + i, 1000 + i) for i in range(shards)]


def _draw(key: Column, children: list[tuple[str, int, float]]) -> Column:
    """The number of the child with the least weighted draw; ties go to the smaller number."""
    if len(children) == 1:
        return F.lit(children[0][1])
    draws = []
    for name, number, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(number).alias("number")))
    return F.array_min(F.array(*draws))["number"]


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key, as an expression; shards of weight 0 get nothing."""
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("a topology needs a shard with a weight over 0")

    def children(level: str, of: list[Shard]) -> list[tuple[str, int, float]]:
        numbers = sorted({getattr(s, level) for s in of})
        return [(f"{level}:{n}", n, sum(s.weight for s in of if getattr(s, level) == n)) for n in numbers]

    def descend(levels: tuple[str, ...], of: list[Shard]) -> Column:
        kids = children(levels[0], of)
        chosen = _draw(key, kids)
        if len(levels) == 1:
            return chosen
        out = F.lit(None).cast("int")
        for _, n, _ in kids:
            out = F.when(chosen == n, descend(levels[1:], [s for s in of if getattr(s, levels[0]) == n])).otherwise(out)
        return out

    return descend(("region", "rack", "shard"), live).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) as doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide, and one more shard, at any number, takes rows only into itself; from eight shards on grown_shard is
    what a call with one more gives. Slots number a shard's rows without gaps.
    They are made from counts of (shard, bucket), at most shards x buckets rows whatever the input, and a row
    number inside each bucket, so no task ever holds a shard. Rows are written once before they are numbered.
    A null text counts as empty; rows with a null doc_id all go to one shard, as equal ids do;
    repeated rows each get a slot; ties in the order of slots are equal rows; very long texts only count their bytes; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, topology(shards, min(8, shards))).alias("shard"),
        place(key, topology(shards + 1, min(8, shards))).alias("grown_shard"),
    )
    rows = cut(rows.withColumn("bucket", salt(buckets, "doc_id", "size", "text_crc32")))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard"
    )
