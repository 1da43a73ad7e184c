"""Connected components of an undirected graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.store import drop, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of ``edges`` (a, b: long); comp is the smallest node reachable.

    Every round each node takes the smallest grandparent among its own and its neighbours' and hangs its parent there
    too, so trees halve in depth; rounds are written out, so lost executors cost one round. Minima are aggregated
    before they are shuffled and hot nodes only meet joins that adaptive execution can split.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = staged(both.toDF("u", "v"), "edges")
    f = parents = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "parents")
    while True:
        up = f.select(F.col("u").alias("p"), F.col("p").alias("gp"))
        g = staged(f.join(up, "p").select("u", "p", "gp"), "grandparents")
        near = both.join(g.select(F.col("u").alias("v"), F.col("gp").alias("q")), "v").groupBy("u").agg(F.min("q").alias("q"))
        near = g.join(near, "u").select("u", "p", F.least("gp", "q").alias("q"))
        cand = near.select("u", "q").union(near.select(F.col("p").alias("u"), "q")).groupBy("u").agg(F.min("q").alias("q"))
        new = staged(f.join(cand, "u").select("u", F.least("p", "q").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "parents")
        moved = new.filter("moved").limit(1).count()
        for old in (parents, g):
            drop(old)
        parents, f = new, new.select("u", "p")
        if not moved:
            drop(both)
            return f.select(F.col("u").alias("node"), F.col("p").alias("comp"))
