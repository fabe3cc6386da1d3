"""Forward passes as plans: hop, pull and turn over claims, words and a parameter set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import content_id, interior
from ..operators import claims as C
from ..operators import fold, graph, phrases
from .firmware import Firmware


@dataclass
class Knowledge:
    """claims(claim, parts); tallies; witnesses(witness, lineage, trust); paths(parent, path) of words."""

    claims: DataFrame
    tallies: DataFrame
    witnesses: DataFrame | None = None
    paths: DataFrame | None = None

    def read(self, fw: Firmware, allowed=None) -> DataFrame:
        """Claims at their (scoped) standing, refused and weighed by the parameters, with their positions."""
        tallies = fold.scoped(self.tallies, allowed)
        rows = self.claims
        if allowed is not None:
            rows = rows.join(tallies.select("claim").distinct(), "claim", "left_semi")
        rows = fold.with_confidence(rows.join(fold.standings(tallies, self.witnesses), "claim", "left"), fw.k)
        rows = C.refuse_predicates(rows, fw.refuse_predicate)
        if fw.only_predicate:
            rows = C.only_predicates(rows, fw.only_predicate)
        if fw.refuse_witness:
            rows = C.refuse_witnesses(rows, tallies, fw.refuse_witness)
        return C.positions(C.weigh(rows, dict(fw.weigh)), tallies)


def hop(known: Knowledge, keys: DataFrame, fw: Firmware, relation: str | None = None, position: str = "any", limit: int = 24, allowed=None) -> DataFrame:
    """Everything attested about each key, the first so many, in the parameters' order. keys(src, key)"""
    rows = known.read(fw, allowed)
    each = C.claims_each(rows, keys, position, relation, fw.fan)
    order = C.by_position() if fw.order == "witness" and position != "any" else [F.col("conf").desc(), F.col("claim")]
    return C.top(each.drop("rank"), ["src"], limit, order)


def edges(rows: DataFrame) -> DataFrame:
    """Both directions of every claim between its two ends."""
    ends = rows.select(F.element_at("parts", 1).alias("a"), F.element_at("parts", -1).alias("b"), "conf").filter("a <> b")
    return ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "conf"))


def pulled(known: Knowledge, prompts: DataFrame, fw: Firmware, limit: int = 12, allowed=None) -> DataFrame:
    """What a prompt's words pull: the other ends of their claims by summed confidence, its own words left out.

    prompts(prompt, word)"""
    ways = edges(known.read(fw, allowed))
    got = prompts.join(ways, prompts.word == ways.a).groupBy("prompt", F.col("b").alias("node")).agg(F.round(F.sum("conf"), 9).alias("force"), F.count_distinct("word").alias("support"))
    got = got.join(prompts.select("prompt", F.col("word").alias("node")), ["prompt", "node"], "left_anti")
    w = Window.partitionBy("prompt").orderBy(F.col("force").desc(), "node")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def turn(known: Knowledge, prompts: DataFrame, fw: Firmware, allowed=None) -> DataFrame:
    """One election per prompt over the planes couple, continuation, walks and co-occurrence.

    prompts(prompt, path): words of each prompt. Returns prompt, node, and the evidence that elected it."""
    words = prompts.select(F.col("prompt"), F.explode(F.array_distinct("path")).alias("word"))
    couple = pulled(known, words, fw, fw.nearest, allowed).select("prompt", "node", F.col("force").alias("confidence"), F.col("support").alias("agree"))
    planes = couple
    zero = F.lit(0.0)
    if known.paths is not None:
        follow = phrases.follows_suffix(known.paths, prompts.select(F.col("prompt").alias("parent"), "path"), 4)
        follow = follow.select("prompt", F.col("next").alias("node"), F.col("n").cast("double").alias("continuity"))
        planes = planes.join(follow, ["prompt", "node"], "full")
    else:
        planes = planes.withColumn("continuity", zero)
    ways = edges(known.read(fw, allowed))
    if fw.walks:
        starts = words.select(F.col("word").alias("node")).distinct()
        seen = graph.walks(ways, starts, fw.walks, fw.steps, fw.restart, fw.seed, fw.walkfan)
        visits = words.join(seen, words.word == seen.origin).groupBy("prompt", "node").agg(F.sum("visits").cast("double").alias("walks"))
        planes = planes.join(visits, ["prompt", "node"], "left")
    else:
        planes = planes.withColumn("walks", zero)
    keys = [k for k in fw.elect if k in ("agree", "continuity", "confidence", "walks")]
    filled = planes.select("prompt", "node", *[F.coalesce(F.col(k).cast("double"), zero).alias(k) for k in ("agree", "continuity", "confidence", "walks")])
    return graph.elect(filled, "prompt", keys)


def said(session: DataFrame) -> DataFrame:
    """Turns as claims: (session, ordinal, prompt, response, claim); the same pair said again is the same claim.

    session(conv_id, turn, role, text)"""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = session.withColumn("response", F.lead("text").over(w)).withColumn("answered_by", F.lead("role").over(w))
    pairs = rows.filter("role = 'user' and answered_by = 'assistant'")
    return pairs.select(F.col("conv_id"), "turn", F.col("text").alias("prompt"), "response", content_id("response", "text").alias("claim"))


def envelope(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(at most so many rows in id order, one row that says whether any were cut)."""
    return rows.limit(most), rows.limit(most + 1).agg((F.count("*") > most).alias("truncated"))


def interior_of(rows: DataFrame) -> DataFrame:
    return rows.select("claim", F.explode(interior(F.col("parts"))).alias("predicate"))
