"""Claim lookup. claims(claim, parts, conf[, position]); claim_part(claim, pos, part, np) is its inverted index.

Order of the steps matters and is kept: refuse, weigh, rank, cap. A refused claim never takes a place the cap leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import interior


def parts_of(claims: DataFrame) -> DataFrame:
    return claims.select("claim", F.posexplode("parts").alias("pos", "part"), F.size("parts").alias("np"))


def top(rows: DataFrame, by: Sequence[str], fan: int, order: Sequence | None = None) -> DataFrame:
    """At most fan rows per key, by confidence, then id; a rank column is added."""
    w = Window.partitionBy(*by).orderBy(*(order or (F.col("conf").desc(), F.col("claim"))))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= fan)


def claims_each(claims: DataFrame, keys: DataFrame | None, position: str = "any", relation: str | None = None, fan: int = 4096, keep: Sequence[str] | None = None) -> DataFrame:
    """Claims of every key: any part, the first, the last or both ends; with a relation, only those holding it inside.

    A key given twice gets its rows twice. keys(src, key); None: every part at such a place is a key of its own. No key
    gives more than fan claims, so each is cut inside the tasks before it moves or meets the keys, however many claims
    hold it. keep: the columns to carry besides claim and confidence; None: all, joined to what is left."""
    p = F.col("parts")
    first, last = F.col("subject") if "subject" in claims.columns else F.element_at(p, 1), F.element_at(p, -1)
    at = {"any": F.explode(F.array_distinct(p)), "first": first, "last": last, "ends": F.explode(F.array_distinct(F.array(first, last)))}[position]
    rows = claims if relation is None else claims.filter(F.array_contains(interior(p), relation))
    held = top(rows.filter(F.size(p) > 0).select("claim", "conf", *(keep or []), at.alias("key")).filter("key is not null"), ["key"], fan)
    if keys is None:
        got = held.withColumn("src", F.col("key"))
    else:
        got = top(keys.join(held.drop("rank"), "key"), ["src"], fan)
    return got if keep is not None else got.drop("conf").join(claims, "claim")


def claims_like(claims: DataFrame, pattern: Sequence[str | None], fan: int = 4096) -> DataFrame:
    """Claims that fit a pattern: a given first or last part is pinned to its end, given middle parts stand anywhere inside."""
    rows = claims
    first, *middle = pattern[:-1]
    last = pattern[-1]
    if first is not None:
        rows = rows.filter(F.element_at("parts", 1) == first)
    if last is not None:
        rows = rows.filter(F.element_at("parts", -1) == last)
    for m in middle:
        if m is not None:
            rows = rows.filter(F.array_contains(interior(F.col("parts")), m))
    w = Window.orderBy(F.col("conf").desc(), F.col("claim"))
    return rows.orderBy(F.col("conf").desc(), "claim").limit(fan).withColumn("rank", F.row_number().over(w))


def refuse_predicates(claims: DataFrame, predicates: Sequence[str]) -> DataFrame:
    return claims.filter(~F.arrays_overlap(interior(F.col("parts")), F.array(*[F.lit(p) for p in predicates]))) if predicates else claims


def only_predicates(claims: DataFrame, predicates: Sequence[str]) -> DataFrame:
    return claims.filter(F.arrays_overlap(interior(F.col("parts")), F.array(*[F.lit(p) for p in predicates])))


def refuse_witnesses(claims: DataFrame, tallies: DataFrame, names: Sequence[str]) -> DataFrame:
    """Takes out a claim only if every witness that says it is refused."""
    lost = tallies.groupBy("claim").agg(F.bool_and(F.col("witness").isin(list(names))).alias("gone")).filter("gone").select("claim")
    return claims.join(lost, "claim", "left_anti")


def weigh(claims: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Confidence times the least weight of an interior part; 1 if none is weighed."""
    if not weights:
        return claims
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    inner = F.array_min(F.transform(interior(F.col("parts")), lambda p: F.coalesce(F.try_element_at(table, p), F.lit(1.0))))
    return claims.withColumn("conf", F.col("conf") * F.when(F.size("parts") > 2, F.least(F.lit(1.0), inner)).otherwise(F.lit(1.0)))


def positions(claims: DataFrame, tallies: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """A claim's position: the least attested one, else its least place in a path that opens with its own subject.

    paths(parent, path): paths whose parts are entity and claim ids."""
    said = tallies.groupBy("claim").agg(F.min("position").alias("said"))
    rows = claims.join(said, "claim", "left")
    if paths is None:
        return rows.withColumnRenamed("said", "position")
    places = paths.select(F.element_at("path", 1).alias("subject"), F.posexplode("path").alias("place", "claim"))
    held = places.filter("place > 0").groupBy("claim", "subject").agg((F.min("place") + 1).alias("place"))
    rows = rows.withColumn("subject", F.element_at("parts", 1)).join(held, ["claim", "subject"], "left")
    return rows.withColumn("position", F.coalesce("said", "place")).drop("said", "place", "subject")


def by_position() -> list:
    return [F.col("position").asc_nulls_last(), F.col("conf").desc(), F.col("claim")]


def follow(claims: DataFrame, frontier: DataFrame, relation: str) -> DataFrame:
    """One step of a chain: from each node over its first claim of the relation, by position, then confidence.

    frontier(origin, node); claims(claim, parts, conf, position)."""
    node = F.col("subject") if "subject" in claims.columns else F.element_at("parts", 1)
    rows = claims.filter(F.array_contains(interior(F.col("parts")), relation)).select(node.alias("node"), F.element_at("parts", -1).alias("to"), "claim", "conf", "position")
    rows = top(rows, ["node"], 1, by_position()).drop("rank")  # a node's first claim, before any origin meets it
    return top(frontier.join(rows, "node"), ["origin"], 1, by_position()).select("origin", F.col("to").alias("node"))


def chain(claims: DataFrame, origins: DataFrame, alternatives: Sequence[Sequence[str]]) -> DataFrame:
    """Relations followed in order; an origin that does not reach the end of one alternative tries the next."""
    done, left = None, origins
    for k, relations in enumerate(alternatives):
        at = left.select("origin", F.col("origin").alias("node"))
        for r in relations:
            at = follow(claims, at, r)
        at = at.withColumn("alternative", F.lit(k))
        done = at if done is None else done.unionByName(at)
        if k + 1 < len(alternatives):
            left = left.join(at.select("origin"), "origin", "left_anti")
    return done


def translate(lexical: DataFrame, same: DataFrame, fan: int = 8) -> DataFrame:
    """Words to concepts to words of another language. lexical(lemma, language, concept, uses, conf); same(a, b):
    languages taken as equal. Concepts of a word go by uses, then confidence; words of a concept alike, fan at most."""
    w = Window.partitionBy("concept", "to").orderBy(F.col("uses").desc(), F.col("conf").desc(), "translation")
    b = lexical.select(F.col("lemma").alias("translation"), F.col("language").alias("to"), "concept", "uses", "conf")
    b = b.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= fan)  # capped before the join, alike for every word
    a = lexical.select(F.col("lemma").alias("word"), F.col("language").alias("from"), "concept", F.col("uses").alias("word_uses"))
    eq = same.select(F.col("a").alias("from"), F.col("b").alias("to"))
    return a.join(b, "concept").filter("`from` <> `to`").join(eq, ["from", "to"], "left_anti")


def language_closure(spark, pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """Codes equal within some rounds, both ways. pairs(a, b) -> (a, b)."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = both.select("a").unionByName(both.select(F.col("b").alias("a"))).distinct().select("a", F.col("a").alias("b"))
    for _ in range(rounds):
        step = reached.join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        reached = reached.unionByName(step).distinct()
    return reached
