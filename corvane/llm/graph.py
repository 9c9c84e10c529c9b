"""Connected components of links, distributed: smallest labels spread and jump until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str, b: str, limit: int = 0) -> DataFrame:
    """(node, root): each node of the links with the smallest node that it is connected with.

    limit: bytes up to which tables of a row a node are sent whole to the links, measured in each round; beyond it, and by
    default, they meet by shuffles.

    Every round gives a node the smallest root among its neighbours, moves the old root along, and replaces each root by
    its own root, so that the number of rounds follows the logarithm of a chain's length. Minima are combined before the
    shuffle; joins on a node with very many links can be split.
    """
    sent = (lambda df: common.small(df, limit)) if limit else (lambda df: df)
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = common.cut(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    roots = common.cut(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")))
    while True:
        label = sent(roots.select(F.col("node").alias("y"), F.col("root").alias("ry")))
        near = edges.join(label, "y").groupBy(F.col("x").alias("node")).agg(F.min("ry").alias("m"))
        best = sent(roots).join(near, "node").select("node", "root", F.least("root", "m").alias("m"))
        best = common.cut(best) if limit else best
        # a root learns of the smaller root that one of its nodes has met
        moved = best.filter("m < root").groupBy(F.col("root").alias("node")).agg(F.min("m").alias("h"))
        hooked = best.join(sent(common.cut(moved)) if limit else moved, "node", "left").select("node", "root", F.least("m", F.coalesce("h", "m")).alias("new"))
        hooked = common.cut(hooked)
        jump = sent(hooked.select(F.col("node").alias("new"), F.col("new").alias("far")))
        new = common.cut(hooked.join(jump, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
