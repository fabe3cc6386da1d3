"""Planes of evidence for an election: role pull, support bits, sense priors, loss contrast, votes, hubs read upwards.

Each is a set of aggregations over words or claims; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import interior
from .claims import parts_of, top
from .containment import holders_capped
from .phrases import ngrams

#: Words of a prompt that support bits can tell apart, 64 a lane.
LANES = 4


def role_pull(words: DataFrame, salience: DataFrame, base: float = 0.5) -> DataFrame:
    """Pull of each word of each prompt: from the base up with its salience, down if it says little. (prompt, word, pull)

    words(prompt, word); salience(word, info_bits). Salience is taken over the most salient word of the same prompt;
    words without any have none."""
    most = F.max("info_bits").over(Window.partitionBy("prompt"))
    rows = words.select("prompt", "word").distinct().join(salience.select("word", "info_bits"), "word", "left")
    s = F.coalesce(F.col("info_bits") / F.when(most > 0, most), F.lit(0.0))
    rows = rows.withColumn("s", s)
    return rows.select("prompt", "word", F.when(F.col("s") >= 0.5, 0.75 + 0.25 * F.col("s")).otherwise(base * (0.2 + 0.8 * F.col("s"))).alias("pull"))


def support_bits(prompts: DataFrame, edges: DataFrame) -> DataFrame:
    """Which words of a prompt lead to each node, as LANES longs of bits: (prompt, node, bits0, ...).

    prompts(prompt, ordinal, word): ordinals from 0 to 64 * LANES - 1, others are refused."""
    at = F.when(F.col("ordinal").between(0, 64 * LANES - 1), F.col("ordinal")).otherwise(F.raise_error(F.lit("a prompt has too many words for its support bits")).cast("int"))
    rows = prompts.withColumn("ordinal", at).join(edges.select(F.col("a").alias("word"), F.col("b").alias("node")), "word")
    lane = lambda i: F.when(F.expr(f"ordinal div 64 = {i}"), F.expr("shiftleft(1L, int(ordinal % 64))")).otherwise(F.lit(0).cast("long"))
    return rows.groupBy("prompt", "node").agg(*[F.bit_or(lane(i)).alias(f"bits{i}") for i in range(LANES)])


def sense_priors(lexical: DataFrame) -> DataFrame:
    """Log prior of each concept of a word: from its uses where any is known, else from its rank. (lemma, concept, prior)

    lexical(lemma, concept, uses, rank): one row a concept of a lemma."""
    w = Window.partitionBy("lemma")
    total, n = F.sum("uses").over(w), F.count("*").over(w)
    return lexical.select("lemma", "concept", F.when(total > 0, F.log((F.col("uses") + 1) / (total + n))).otherwise(-F.log(F.col("rank").cast("double"))).alias("prior"))


def loss_contrast(words: DataFrame, outcomes: DataFrame) -> DataFrame:
    """How much oftener a word stands in lost paths than in won ones: (word, lost, won, contrast).

    words(parent, word); outcomes(parent, won): a parent's outcome, one row each."""
    total = outcomes.agg(F.count_if(~F.col("won")).alias("n_lost"), F.count_if("won").alias("n_won"))
    rows = words.select("parent", "word").distinct().join(outcomes.select("parent", "won"), "parent")
    per = rows.groupBy("word").agg(F.count_if(~F.col("won")).alias("lost"), F.count_if("won").alias("won"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return per.crossJoin(F.broadcast(total)).select("word", "lost", "won", (share("lost", "n_lost") - share("won", "n_won")).alias("contrast"))  # one row


def by_usage(claims: DataFrame, tallies: DataFrame | None, by: Sequence[str], fan: int) -> DataFrame:
    """Claims of each key by the games seen of them, then position, confidence and id; fan at most. Without tallies the
    claims bring their uses."""
    if tallies is not None:
        claims = claims.join(tallies.groupBy("claim").agg(F.sum("games").alias("uses")), "claim")
    order = [F.col("uses").desc(), F.col("position").asc_nulls_last(), F.col("conf").desc(), F.col("claim")]
    return top(claims, by, fan, order)


def take_segment(paths: DataFrame, segments: DataFrame, n: int) -> DataFrame:
    """The majority continuation of segments of n words: none if more paths end than go on, or no two agree.

    (segment, next, times, on, ended)"""
    seen = ngrams(paths, n).join(segments.select("segment").distinct(), "segment").groupBy("segment", "next").agg(F.count("*").alias("times"))
    w = Window.partitionBy("segment")
    ended = F.coalesce(F.sum(F.when(F.col("next").isNull(), F.col("times"))).over(w), F.lit(0))
    rows = seen.withColumn("ended", ended).withColumn("on", F.sum("times").over(w) - F.col("ended")).filter("next is not null")
    rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.col("times").desc(), "next")))
    return rows.filter("r = 1 and times >= 2 and on >= ended").select("segment", "next", "times", "on", "ended")


def upward(claims: DataFrame, relations: Sequence[str], cap: int) -> DataFrame:
    """Hubs read again together with each upward relation: (hub, relation, claim) of claims a capped read leaves out."""
    held = parts_of(claims).select(F.col("claim").alias("parent"), F.col("part").alias("child"), "pos")
    hubs = holders_capped(held, cap)[1].select(F.col("child").alias("hub"))
    said = claims.select("claim", F.explode(F.array_distinct(interior(F.col("parts")))).alias("relation")).filter(F.col("relation").isin(list(relations)))
    ends = parts_of(claims).select("claim", F.col("part").alias("hub")).distinct()
    return said.join(ends, "claim").join(hubs, "hub", "left_semi").filter("hub <> relation").select("hub", "relation", "claim")


def in_order(keysets: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Attributes of lists of keys, in the order asked and with repeats; keys not known stay, without attributes.

    keysets(set_id, keys) -> (set_id, ordinal, key, attributes)"""
    asked = keysets.select("set_id", F.posexplode("keys").alias("ordinal", key))
    return asked.join(attributes, key, "left").select("set_id", "ordinal", *attributes.columns)


def records(claims: DataFrame, by: str, order: Sequence[str], ident) -> DataFrame:
    """Record ids: a record is its claims in order; a claim that is a record's only one, said once, is the record.

    ident: the id of an array of ids, as a function of a column. (by, n, record_id)"""
    rows = claims.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, "claim")))["claim"].alias("c"))
    return rows.select(by, F.size("c").cast("long").alias("n"), F.when(F.size("c") == 1, F.get("c", F.lit(0))).otherwise(ident(F.col("c"))).alias("record_id"))


def said_once(turns: DataFrame, session: str, order: Sequence[str], claim: str = "claim") -> DataFrame:
    """A turn said again is recorded once, and the next turn takes the next place: a `place` column from 1 is added."""
    w = Window.partitionBy(session, claim).orderBy(*order)
    once = turns.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(*order, claim)))
