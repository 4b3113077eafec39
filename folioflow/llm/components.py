"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, hold: Scratch, name: str = "cc") -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex of ``edges`` (a, b).

    Every round takes the least label among a vertex and its neighbours, then the label's own
    label; path lengths halve, so the rounds grow with the logarithm of the longest path.
    Each round is a table in the shared folder; the driver only sees a count of changes.
    """
    both = hold.keep(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).filter("u <> v").distinct(), f"{name}_edges")
    labels = hold.keep(both.groupBy("v").agg(F.least(F.first("v"), F.min("u")).alias("c")), f"{name}_0")
    turn = 0
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(F.min("cu").alias("m"))
        low = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("c").alias("far"))
        turn += 1
        after = hold.keep(low.join(jump, "low").select("v", F.least("low", "far").alias("c"), (F.least("low", "far") < F.col("c")).alias("moved")), f"{name}_{turn}")
        changed = after.filter("moved").limit(1).count()
        hold.drop(f"{name}_{turn - 1}")
        labels = after.select("v", "c")
        if not changed:
            hold.drop(f"{name}_edges")
            return labels
