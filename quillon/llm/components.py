"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge list of BIGINTs; root is the least node of its component.

    Each round is two hash joins on a node; it ends when every edge points to a root,
    after about log(n) rounds. Self loops name single nodes; null ends are dropped; no
    edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).dropna()
    now, path = materialize(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        links = now.filter("u <> v")
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        rest = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = rest.union(least.select("u", F.col("m").alias("v"))).union(now.filter("u = v")).distinct()
        new, new_path = materialize(new, "edges")
        new_state = _state(new)
        discard(spark, path)
        now, path, state, before = new, new_path, new_state, state
        if state == before:
            break
    tree = now.filter("u <> v")
    roots = tree.select(F.col("v").alias("node")).union(now.filter("u = v").select(F.col("u").alias("node"))).distinct()
    roots = roots.join(tree.select(F.col("u").alias("node")), "node", "left_anti")
    return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
