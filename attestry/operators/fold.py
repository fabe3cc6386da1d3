"""Testimony: observations -> tallies -> standings; provenance, retraction, replay, attribution.

observations(claim, witness, lineage, record, score, run, games, position): one row each time a record says a claim.
tallies(claim, witness, lineage, games, tokens, wins, position). standings(claim, rating, deviation, matches)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import INITIAL_DEVIATION, INITIAL_RATING, INITIAL_VOLATILITY, confidence, matchup_weight, opponent_deviation, standing_columns


def dedupe_records(said: DataFrame) -> DataFrame:
    """The same claim of the same record again raises its run instead of adding an observation."""
    keys = [c for c in ("claim", "witness", "lineage", "record", "qualifier") if c in said.columns]
    return said.groupBy(*keys).agg(F.count("*").cast("int").alias("run"), F.avg("score").alias("score"), F.min("position").alias("position"))


def tally(observations: DataFrame, by: Sequence[str] = ("claim", "witness", "lineage")) -> DataFrame:
    """Per claim, witness and lineage. An observation plays its run if it counts games, else once; position 0 is none."""
    played = F.when(F.col("games"), F.col("run")).otherwise(F.lit(1)).cast("long")
    return observations.groupBy(*by).agg(
        F.sum(played).alias("games"),
        F.sum(F.col("run").cast("long")).alias("tokens"),
        F.sum(F.col("score") * played).alias("wins"),
        F.min(F.nullif(F.col("position"), F.lit(0))).alias("position"),
    )


def scoped(tallies: DataFrame, allowed: DataFrame | Sequence[str] | None) -> DataFrame:
    """Only what these witnesses say. None is everyone; an empty list is no one, and gives nothing."""
    if allowed is None:
        return tallies
    if not isinstance(allowed, DataFrame):
        if not allowed:
            return tallies.filter(F.lit(False))
        return tallies.filter(F.col("witness").isin(list(allowed)))
    return tallies.join(allowed.select("witness").distinct(), "witness", "left_semi")


def standings(tallies: DataFrame, witnesses: DataFrame | None = None, trust: float = 0.5, claim: str = "claim") -> DataFrame:
    """One rating period: a matchup per lineage against an equal whose deviation shrinks with its witnesses' trust."""
    rows = tallies
    if witnesses is not None:
        rows = rows.join(witnesses.select("witness", F.col("trust").alias("t")), "witness", "left")
    else:
        rows = rows.withColumn("t", F.lit(None).cast("double"))
    lineages = rows.groupBy(claim, "lineage").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.max(F.coalesce("t", F.lit(trust))).alias("t"))
    return rate(lineages, (claim,))


def rate(lineages: DataFrame, by: Sequence[str] = ("claim",)) -> DataFrame:
    """standings() from one row per claim and lineage: (by, lineage, games, wins, t[, position]); the least position stays."""
    g = matchup_weight(opponent_deviation(F.col("t")))
    per = lineages.withColumn("g", g).withColumn("s", F.col("wins") / F.col("games"))
    least = [F.min("position").alias("position")] if "position" in lineages.columns else []
    sums = per.groupBy(*by).agg(F.sum(F.col("g") * F.col("g")).alias("information"), F.sum(F.col("g") * (F.col("s") - 0.5)).alias("gain"), F.sum("games").alias("matches"), *least)
    rating, deviation = standing_columns(F.col("information"), F.col("gain"))
    return sums.select(*by, rating.alias("rating"), deviation.alias("deviation"), "matches", *(["position"] if least else []))


def with_confidence(rows: DataFrame, k: float = 2.0) -> DataFrame:
    """Claims without a standing read at the initial one. Nine digits are kept, so that the order of a sum's terms never
    decides between equal claims."""
    r, d = F.coalesce("rating", F.lit(INITIAL_RATING)), F.coalesce("deviation", F.lit(INITIAL_DEVIATION))
    return rows.withColumn("conf", F.round(confidence(r, d, k), 9))


def glicko2(rating: float, deviation: float, volatility: float, games: Sequence[tuple[float, float, float]], tau: float = 0.5) -> tuple[float, float, float]:
    """One Glicko-2 period with the volatility iteration; games: (opponent rating, opponent deviation, score)."""
    from math import exp, log, pi, sqrt

    scale = 173.7178
    mu, phi = (rating - INITIAL_RATING) / scale, deviation / scale
    if not games:
        return rating, scale * sqrt(phi * phi + volatility**2), volatility
    terms = []
    for r, d, s in games:
        g = 1 / sqrt(1 + 3 * (d / scale) ** 2 / pi**2)
        terms.append((g, 1 / (1 + exp(-g * (mu - (r - INITIAL_RATING) / scale))), s))
    v = 1 / sum(g * g * e * (1 - e) for g, e, _ in terms)
    gain = sum(g * (s - e) for g, e, s in terms)
    delta, a = v * gain, log(volatility**2)

    def f(x: float) -> float:
        ex = exp(x)
        return ex * (delta**2 - phi**2 - v - ex) / (2 * (phi**2 + v + ex) ** 2) - (x - a) / tau**2

    lo, hi = a, log(delta**2 - phi**2 - v) if delta**2 > phi**2 + v else a - tau
    while delta**2 <= phi**2 + v and f(hi) < 0:
        hi -= tau
    flo, fhi = f(lo), f(hi)
    while abs(hi - lo) > 1e-6:
        mid = lo + (lo - hi) * flo / (fhi - flo)
        fmid = f(mid)
        if fmid * fhi <= 0:
            lo, flo = hi, fhi
        else:
            flo /= 2
        hi, fhi = mid, fmid
    sigma = exp(lo / 2)
    star = sqrt(phi * phi + sigma * sigma)
    new = 1 / sqrt(1 / star**2 + 1 / v)
    return scale * (mu + new * new * gain) + INITIAL_RATING, scale * new, sigma


def glicko2_standings(tallies: DataFrame, trust: float = 0.5) -> DataFrame:
    """Standings with volatility. Lineages of a claim, one matchup each, are folded inside Arrow groups of claims."""
    d = 30 + 160 * (1 - trust)

    def fold(batches):
        for pdf in batches:
            rows = [(c, *glicko2(INITIAL_RATING, INITIAL_DEVIATION, INITIAL_VOLATILITY, [(INITIAL_RATING, d, w) for w in s])) for c, s in zip(pdf["claim"], pdf["scores"], strict=True)]
            yield pd.DataFrame(rows, columns=["claim", "rating", "deviation", "volatility"])

    per = tallies.groupBy("claim", "lineage").agg((F.sum("wins") / F.sum("games")).alias("s"))
    return per.groupBy("claim").agg(F.sort_array(F.collect_list("s")).alias("scores")).mapInPandas(fold, "claim string, rating double, deviation double, volatility double")


def provenance(tallies: DataFrame, witnesses: DataFrame | None = None) -> DataFrame:
    """Who says a claim: games, tokens, mean score and trust per witness."""
    rows = tallies.groupBy("claim", "witness").agg(F.sum("games").alias("games"), F.sum("tokens").alias("tokens"), (F.sum("wins") / F.sum("games")).alias("mean_score"), F.min("position").alias("position"))
    return rows if witnesses is None else rows.join(witnesses.select("witness", "trust"), "witness", "left")


def forget(tallies: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(tallies without these witnesses, claims that lose testimony: claim, kept); kept is false if no one else says it."""
    theirs = F.col("witness").isin(list(names))
    marks = tallies.groupBy("claim").agg(F.max(theirs).alias("theirs"), F.max(~theirs).alias("kept")).filter("theirs").select("claim", "kept")
    return tallies.filter(~theirs), marks


def sweep(entities: DataFrame, claim_parts: DataFrame) -> DataFrame:
    """Entities no path holds."""
    return entities.join(claim_parts.select(F.col("part").alias("id")).distinct(), "id", "left_anti")


def differing(stored: DataFrame, again: DataFrame, key: str = "claim", unique: bool = False) -> DataFrame:
    """Keys of rows that one of two tables holds oftener than the other; replay expects none. Each is read once.

    unique: no key is null or stands twice in a table, so rows are compared by a join on the key alone; tables already
    dealt by it are not moved again."""
    if unique:
        value = lambda t: t.select(key, F.struct(*[c for c in stored.columns if c != key]).alias("__v"))
        both = value(stored).join(value(again).withColumnRenamed("__v", "__w"), key, "full")
        return both.filter(~F.col("__v").eqNullSafe(F.col("__w"))).select(key)
    both = stored.withColumn("__n", F.lit(1)).unionByName(again.withColumn("__n", F.lit(-1)))
    return both.groupBy(*stored.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0").select(key).distinct()


def apportion(shares: DataFrame, key: str, name: str, amount: str, total: int = 10_000) -> DataFrame:
    """Hamilton's method: integer parts of the total per key, in proportion to the amounts, that sum to it exactly.

    The amounts of a key are first summed per name, so a window holds one row per name."""
    rows = shares.groupBy(key, name).agg(F.sum(amount).alias("amount")).filter("amount > 0")
    whole = Window.partitionBy(key)
    exact = rows.withColumn("exact", F.col("amount") * total / F.sum("amount").over(whole)).withColumn("base", F.floor("exact"))
    rest = exact.withColumn("short", F.lit(total) - F.sum("base").over(whole))
    order = Window.partitionBy(key).orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), F.col("amount").desc(), F.col(name))
    return rest.withColumn("bp", F.col("base") + (F.row_number().over(order) <= F.col("short")).cast("long")).select(key, name, "bp")


def lineage_counts(tallies: DataFrame, namespace: str) -> DataFrame:
    """Per namespace: claims attested at all and by at least two, three and four independent lineages."""
    per = tallies.groupBy(namespace, "claim").agg(F.count_distinct("lineage").alias("n"))
    return per.groupBy(namespace).agg(F.count("*").alias("attested"), *[F.count_if(F.col("n") >= k).alias(f"by{k}") for k in (2, 3, 4)])


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The value with most votes per key; two equal leaders give none."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("votes"))
    top = F.max("votes").over(Window.partitionBy(key))
    led = counts.withColumn("top", top).filter("votes = top").groupBy(key).agg(F.count("*").alias("leaders"), F.min(value).alias(value), F.max("votes").alias("votes"))
    return led.filter("leaders = 1").select(key, value, "votes")
