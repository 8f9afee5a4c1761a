"""Connected components of a similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .skew import join_lookup


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """One row (id, root) for each id with an edge in undirected ``edges`` (a, b); ids of any ordered type.

    root is the smallest id reachable. Large-star and small-star rounds alternate; both are equi-joins with a
    partial minimum, and hubs are looked up by a broadcast of bounded size, so a hub's edges spread over tasks. Each
    round is written to the shared folder. Edges with a null end and loops are ignored; no edge at all gives no row.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = scratch.save(e.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    seen, n = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("m"), "n")
        large = scratch.save(join_lookup(both, low, ["v"], "n", 2 * n).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = join_lookup(large, low, ["v"], "n", n).select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*")
        new = scratch.save(small.where("v <> u").distinct(), "small")
        scratch.drop(e, large)
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        seen, n = state, state[0]
    raise RuntimeError("components did not settle")
