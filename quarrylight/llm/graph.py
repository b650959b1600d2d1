"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b) reaches: node, component.

    Labels move along the links and then jump to their label's label, so a chain takes about
    the logarithm of its length in rounds.  Each round's labels are written, and the round
    before is dropped.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).where(F.col("node") != F.col("other"))
    both = scratch.keep(both.distinct(), f"{name}-links")
    labels = scratch.keep(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("component", "near").alias("step"), F.col("component").alias("old"))
        step = scratch.keep(step, f"{name}-{turn}-step")
        jump = step.select(F.col("node").alias("step"), F.col("step").alias("far"))
        now = step.join(jump, "step", "left").select("node", F.least("step", "far").alias("component"), (F.least("step", "far") != F.col("old")).alias("changed"))
        now = scratch.keep(now, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}-step", f"{name}-{turn - 1}")
        labels = now.select("node", "component")
        if not now.where("changed").limit(1).count():
            scratch.drop(f"{name}-links")
            return labels
