"""Connected components of an edge table, as written tables: least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of an edge (a, b); comp is the least node of its component.

    Each round takes the least label among neighbours, pre-aggregated before its shuffle so that a hub of any degree is
    one sum per task, then jumps to the label's own label; rounds grow with the logarithm of a component's diameter."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(seen, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("m", "comp")).alias("next"))
        step = written(step, "labels")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        labels = written(step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("jumped", "next")).alias("comp")), "labels")
        if labels.filter("comp <> was").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
