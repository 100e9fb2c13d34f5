"""Closure of edge tables: connected components, blocks over them, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.ranking import least_of_key
from loomfield.storage import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): every node of an edge between two nodes, with the least node it
    reaches. Alternating large-star and small-star steps: rows meet the minima of their keys in one shuffle, those of
    large neighbourhoods in parts, so none meets in one task; each step ends in a stored table. Rounds go on until the
    edges no longer change, which takes about the logarithm of the longest path of them."""
    live = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_of_key(both, "u", "v", "m", "v").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = least_of_key(stored(large, "stars"), "u", "v", "m", "v")
        # A node goes to its least neighbour with all others; the row of that neighbour stands for the node itself.
        live = stored(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        state = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = live.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return live.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = state


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node) -> (node, root), nodes without edges being their own roots."""
    return nodes.join(connected_components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def shared_key_edges(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Edges (a, b) that connect rows which share a value of any key: a star for each value, from its
    least node, so a value of n rows costs n edges. Null keys connect nothing; rows are read twice."""
    long = rows.select(
        F.col(node).alias("node"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])).alias("x")
    ).select("node", "x.k", "x.v").filter("v IS NOT NULL")
    hubs = least_of_key(long.select("node", F.struct("k", "v").alias("key")), "key", "node", "b", "node")
    return hubs.select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def component_ids(members: DataFrame) -> DataFrame:
    """(root, component_id, size): members(node, root) addressed by the content of each component."""
    return members.groupBy("root").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ","), 256).alias("component_id"),
        F.count("*").alias("size"),
    )


def quarantined(members: DataFrame, bad: DataFrame) -> DataFrame:
    """members(node, root) with a flag: some node of the component is in bad(node)."""
    roots = members.join(bad, "node", "left_semi").select("root").distinct().withColumn("_bad", F.lit(True))
    return members.join(roots, "root", "left").select("node", "root", F.coalesce("_bad", F.lit(False)).alias("quarantined"))
