"""Cost-based search over a claim graph: nearest by chain cost, layers of force, walks with restart.

edges(a, b, conf): both directions are given. Frontiers are tables; each round is one join, hubs are reached but not
crossed, and a node keeps its least cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import cost, draw
from ..sources.work import written


def crossable(edges: DataFrame, fan: int) -> DataFrame:
    """Edges that leave nodes of at most fan edges; the rest are hubs."""
    degree = edges.groupBy("a").agg(F.count("*").alias("degree")).filter(F.col("degree") <= fan).select("a")
    return edges.join(degree, "a", "left_semi")


def degrees(edges: DataFrame, origins: DataFrame, hops: int, per_hop: float = 0.05, fan: int = 4096) -> DataFrame:
    """Least chain cost from each origin to every node within the hops: (origin, node, hops, cost, conf).

    Origins are read whole even if they are hubs. conf is what the chain's claims hold together, without the tax."""
    step = edges.select("a", "b", cost(F.col("conf"), per_hop).alias("c"))
    inner = written(crossable(edges, fan).select("a", "b", cost(F.col("conf"), per_hop).alias("c")), "ways")
    best = origins.select(F.col("node").alias("origin"), "node").withColumn("hops", F.lit(0)).withColumn("cost", F.lit(0.0))
    frontier = best
    for h in range(1, hops + 1):
        via = step if h == 1 else inner
        reached = frontier.join(via, frontier.node == via.a).select("origin", F.col("b").alias("node"), F.lit(h).alias("hops"), (F.col("cost") + F.col("c")).alias("cost"))
        least = reached.groupBy("origin", "node").agg(F.min("cost").alias("cost")).withColumn("hops", F.lit(h))
        known = best.groupBy("origin", "node").agg(F.min("cost").alias("was"))
        frontier = written(least.join(known, ["origin", "node"], "left").filter("was is null or cost < was").select("origin", "node", "hops", "cost"), "frontier")
        if frontier.isEmpty():
            break
        best = best.unionByName(frontier)
    out = best.groupBy("origin", "node").agg(F.min(F.struct("cost", "hops")).alias("m"))
    return out.select("origin", "node", "m.hops", "m.cost", F.exp(-(F.col("m.cost") - per_hop * F.col("m.hops"))).alias("conf"))


def nearest(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("origin").orderBy("cost", "node")
    return found.filter("origin <> node").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def layer(edges: DataFrame, cells: DataFrame, breadth: int, rounds: int = 1) -> DataFrame:
    """Coupling rounds: in each the strongest cells push conf * force / outdegree along their edges. cells(node, force)."""
    ways = edges if rounds == 1 else written(edges.select("a", "b", "conf"), "ways")
    for r in range(rounds):
        strongest = cells.orderBy(F.col("force").desc(), "node").limit(breadth)
        out = ways.join(strongest, ways.a == strongest.node)
        degree = out.groupBy("a").agg(F.count("*").alias("degree"))
        pushed = out.join(degree, "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("conf") * F.col("force") / F.col("degree")).alias("force"))
        # rounded, so that which cells are strongest next does not hang on the order of the sum
        cells = cells.select("node", "force").unionByName(pushed).groupBy("node").agg(F.round(F.sum("force"), 9).alias("force"))
        if r + 1 < rounds:
            cells = written(cells, "cells")
    return cells


def walks(edges: DataFrame, origins: DataFrame, walkers: int, steps: int, restart: float, seed: str, walkfan: int = 512) -> DataFrame:
    """Visits of random walks with restart; every draw is the hash of the seed and its place, so runs agree.

    The edge drawn is the first whose share of the node's confidence, added up in order of id, passes the draw.
    (origin, node, visits)"""
    order = Window.partitionBy("a").orderBy("b")
    whole = Window.partitionBy("a")
    ways = edges.groupBy("a", "b").agg(F.max("conf").alias("conf"))
    ways = ways.withColumn("n", F.count("*").over(whole)).filter(F.col("n") <= walkfan)
    share = F.sum("conf").over(order) / F.sum("conf").over(whole)
    ways = ways.withColumn("hi", F.when(F.col("b") == F.last("b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(1.0)).otherwise(share))
    ways = written(ways.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).select("a", "b", "lo", "hi"), "ways")
    at = origins.select(F.col("node").alias("origin"), "node").withColumn("walker", F.explode(F.sequence(F.lit(1), F.lit(walkers))))
    seen = None
    for s in range(1, steps + 1):
        place = [F.lit(seed), F.col("origin").cast("string"), F.col("walker").cast("string"), F.lit(str(s))]
        drawn = at.withColumn("home", draw(*place, F.lit("home")) < restart).withColumn("u", draw(*place, F.lit("step")))
        moved = drawn.join(ways, (F.col("node") == F.col("a")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")), "left")
        at = written(moved.select("origin", "walker", F.when(F.col("home") | F.col("b").isNull(), F.col("origin")).otherwise(F.col("b")).alias("node")), "walkers")
        seen = at if seen is None else seen.unionByName(at)
    return seen.groupBy("origin", "node").agg(F.count("*").alias("visits"))


def elect(proposals: DataFrame, key: str, order: list[str], name: str = "node") -> DataFrame:
    """The first proposal per key by the election keys in order, each descending, then by name."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order], name)
    return proposals.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def draw_within(rows: DataFrame, key: str, name: str, value: str, within: float, seed: str) -> DataFrame:
    """Of the rows of each key whose value is within a share of the best, the one of the least seeded draw. (key, name)"""
    near = rows.withColumn("__best", F.max(value).over(Window.partitionBy(key))).filter(F.col(value) >= F.col("__best") * F.lit(1 - within))
    return near.groupBy(key).agg(F.min_by(name, F.struct(draw(F.lit(seed), F.col(key), F.col(name)), name)).alias(name))
