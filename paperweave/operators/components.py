"""Connected components: of edges by large-star and small-star rounds, over shared keys by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.sources.lineage import dropped, written


def _stars(edges: DataFrame) -> bool:
    """Has every node one parent at most, and none that is a child itself?"""
    roles = edges.select(F.col("a").alias("node"), F.col("b").alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).alias("parent")))
    told = roles.groupBy("node").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"), F.max(F.col("parent").isNull()).alias("leads"))
    return not told.filter("lo is not null and (leads or lo < hi)").limit(1).count()


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) as node, root: the least node reachable. A round links each node's larger neighbours, then its smaller ones, to the
    least of them; both are aggregations, combined before the shuffle, and joins that AQE can split. Edges are written after each round; there are
    rounds until all edges lead to a root, and they grow with the logarithm of the longest chain."""
    state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _stars(state):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, state = state, written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        dropped(before)
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _contracted(edges: DataFrame) -> DataFrame:
    """edges (a, b) as node, part: nodes have one part if and only if one reaches the other; a node that is not told is its own. In a round each node goes over to the first of itself and its neighbours and takes its edges with it, so that only edges between those are left.
    First is the least in the first round, so that nodes of a kind that is named first take in the others, and then the least of a hash that is another in each round: no order of names makes a long chain of rounds. What is left shrinks by a share each round; all
    rounds together shuffle and write little more than the first."""
    def distinct(x: str, y: str, rows: DataFrame) -> DataFrame:
        return written(rows.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct())

    state, levels = distinct("a", "b", edges), []
    while not state.isEmpty():
        place = (lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("h"), F.col(c).alias("c"))) if levels else F.col
        first = F.least(place("a"), F.min(place("b")))
        up = written(state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg((first["c"] if levels else first).alias("up")).filter("up <> a"))
        levels.append(up)
        moved = state.join(up.withColumnRenamed("up", "x"), "a", "left").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b", "left")
        moved = moved.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        before, state = state, distinct("x", "y", moved)
        dropped(before)
    if not levels:
        return state.select(F.col("a").alias("node"), F.col("b").alias("part"))
    found = levels.pop().select(F.col("a").alias("node"), F.col("up").alias("part"))
    while levels:
        # those that moved in this round follow those that moved later; who took in others in one round and moved on is told in several, with the same part
        above = found.select(F.col("node").alias("up"), "part")
        found = found.unionByName(levels.pop().join(above, "up", "left").select(F.col("a").alias("node"), F.coalesce("part", "up").alias("part"))).groupBy("node").agg(F.min("part").alias("part"))
        if levels:
            found = written(found)
    return found


def with_parts(rows: DataFrame, node: str, *keys: str | Column) -> DataFrame:
    """rows with a column part: rows that share a node, or a value of any of the keys, directly or through others, have one part. A row whose node is null has none.

    Not the rows but their keys are the graph: a row joins its first key to its others, and rows that hold the same keys are one edge; a key of very many rows is one vertex and no list. A row then finds its part by its first key alone, and only nodes
    that stand on several rows are looked up by themselves. rows are read three times."""
    texts = [F.col(k) if isinstance(k, str) else k for k in keys]
    held = F.array_compact(F.array(*(F.when(k.isNotNull(), F.concat(F.lit(f"{i}\u0001"), k.cast("string"))) for i, k in enumerate(texts))))
    own, key, name = (_free(rows, n) for n in ("held", "key", "part"))
    rows = rows.withColumn(own, held)
    keyed = rows.select(F.col(node).alias("node"), F.col(own).alias("held"), F.get(own, F.lit(0)).alias("key"))
    edges = keyed.filter(F.size("held") > 1).select(F.col("key").alias("a"), F.explode(F.slice("held", 2, len(texts))).alias("b"))
    # a node that stands on several rows joins their keys as well
    several = written(keyed.filter("node is not null").groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"))
    twice = keyed.join(several, "node", "left_semi").filter("key is not null").select("node", "key").distinct()
    none = several.isEmpty()
    if not none:
        twice = written(twice)
        edges = edges.unionByName(twice.join(twice.groupBy("node").agg(F.min("key").alias("a")), "node").select("a", F.col("key").alias("b")))
    found = _contracted(edges)
    rows = rows.withColumn(key, F.get(own, F.lit(0))).join(found.select(F.col("node").alias(key), F.col("part").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    if not none:
        parts = written(twice.join(found.withColumnRenamed("node", "key"), "key", "left").groupBy("node").agg(F.min(F.coalesce("part", "key")).alias("of_node")))
        rows = rows.join(parts.withColumnRenamed("node", "of_" + key).withColumnRenamed("of_node", "of_" + name), F.col(node) == F.col("of_" + key), "left").withColumn(name, F.coalesce("of_" + name, name)).drop("of_" + key, "of_" + name)
    alone = F.concat(F.lit("\u0002"), F.col(node).cast("string"))
    return rows.withColumn(name, F.when(F.col(node).isNotNull(), F.coalesce(name, alone))).drop(own, key).withColumnRenamed(name, "part")


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def components_by_key(rows: DataFrame, node: str, *keys: str) -> DataFrame:
    """node, root of rows that share a value of any of the key columns; rows without a partner are their own root.

    A component's root is its least node, from an aggregate by component. Rows of one node count together."""
    placed = with_parts(rows.select(node, *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys))), node, *(f"key_{i}" for i in range(len(keys)))).select(node, "part").distinct()
    roots = placed.groupBy("part").agg(F.min(node).alias("root"))
    return placed.join(roots, "part", "left").select(node, F.coalesce("root", node).alias("root"))
