"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INITIAL_RATING, INITIAL_DEVIATION, INITIAL_VOLATILITY = 1500.0, 350.0, 0.06
_Q = math.log(10) / 400
UNIT = "\x1f"


def content_id(*parts: Column | str) -> Column:
    """Content id of an ordered composition: 32 hex digits."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, 32)


def content_id_of(array: Column | str) -> Column:
    """Content id of an array of child ids or texts; one child is that child itself."""
    arr = F.col(array) if isinstance(array, str) else array
    return F.when(F.size(arr) == 1, F.element_at(arr, 1)).otherwise(F.substring(F.sha2(F.array_join(arr, UNIT), 256), 1, 32))


def rescale(value: Column, low: float, high: float) -> Column:
    """Score of a number on the scale [low, high], clamped to [0, 1]; missing counts as a win."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(float(high) - float(low)))), F.lit(1.0))


def confidence(rating: Column, deviation: Column, k: float = 2.0) -> Column:
    """How likely a claim still holds, read k deviations below its rating."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (F.lit(INITIAL_RATING) - (rating - F.lit(float(k)) * deviation)) / F.lit(400.0)))


def cost(conf: Column, per_hop: float = 0.05, weight: Column | None = None) -> Column:
    """Cost of crossing a claim: additive in -ln confidence, a tax per hop, less the log of its weight."""
    base = -F.log(conf) + F.lit(per_hop)
    return base if weight is None else base - F.log(weight)


def opponent_deviation(trust: Column) -> Column:
    """A trusted witness is a well-known opponent; trust is in [-1, 1]."""
    return F.lit(30.0) + F.lit(160.0) * (F.lit(1.0) - trust)


def matchup_weight(deviation: Column) -> Column:
    return 1.0 / F.sqrt(F.lit(1.0) + F.lit(3 * _Q * _Q / (math.pi**2)) * deviation * deviation)


def standing_columns(information: Column, gain: Column) -> tuple[Column, Column]:
    """(rating, deviation) after one rating period against equals: information = sum g^2, gain = sum g (s - 1/2)."""
    precision = F.lit(1 / INITIAL_DEVIATION**2) + F.lit(_Q * _Q / 4) * information
    return F.lit(INITIAL_RATING) + F.lit(_Q) * gain / precision, F.sqrt(1.0 / precision)


def other_end(parts: Column, self_: Column) -> Column:
    """The other end of a claim: subject for object and object for subject, null for an interior part."""
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    return F.when(first == self_, last).when(last == self_, first)


def interior(parts: Column) -> Column:
    """The parts between subject and object; for a pair, its second part."""
    return F.when(F.size(parts) <= 2, F.slice(parts, 2, 1)).otherwise(F.slice(parts, F.lit(2), F.size(parts) - 2))


def words(text: Column | str) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), 1)


def run_length(array: Column) -> Column:
    """Run-length encoding of an array: structs (id, run)."""
    seed = F.array().cast("array<struct<id:string,run:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["id"].alias("id"), (last["run"] + 1).alias("run"))))
        new = F.concat(acc, F.array(F.struct(x.alias("id"), F.lit(1).alias("run"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["id"] == x), grown).otherwise(new)

    return F.aggregate(array, seed, step)


def expand_runs(path: Column) -> Column:
    """Inverse of run_length."""
    return F.flatten(F.transform(path, lambda v: F.array_repeat(v["id"], v["run"])))


def draw(*parts: Column | str) -> Column:
    """A deterministic draw in [0, 1) from the hash of its parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two vectors of columns."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    na, nb = (F.sqrt(sum((x * x for x in v), F.lit(0.0))) for v in (a, b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (na * nb))))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
