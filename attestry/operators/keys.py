"""Keys and references between records: first declaration wins, admission, typed vocabularies, unpivoted statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import rescale


def first_declared(rows: DataFrame, key: Sequence[str], rank: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Of several declarations of a key the one of least rank holds, whenever it arrives. A null value blocks later ones."""
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*value), F.struct(*rank)).alias("v"))
    return picked.select(*key, *[F.col(f"v.{c}").alias(c) for c in value])


def resolve(rows: DataFrame, ref: str, declared: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with what their reference names, references that nothing declares and how often)."""
    d = declared.select(F.col(key).alias("__k"), F.col(value).alias("resolved"))
    joined = rows.join(d, F.col(ref) == F.col("__k"), "left")
    lost = joined.filter(F.col("__k").isNull() & F.col(ref).isNotNull()).groupBy(ref).agg(F.count("*").alias("times"))
    return joined.filter(F.col("__k").isNotNull()).drop("__k"), lost


def admit(rows: DataFrame, refs: Sequence[str], domain: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose every reference is in the domain, one row with how many were excluded)."""
    keys = domain.select(F.col(key).alias("__k")).distinct()
    kept = rows
    for r in refs:
        kept = kept.join(keys, F.col(r) == F.col("__k"), "left_semi")
    counts = rows.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("k")))  # one row each
    return kept, counts.select((F.col("n") - F.col("k")).alias("excluded"))


def typed(rows: DataFrame, text: str, lists: DataFrame, order: Sequence[str]) -> DataFrame:
    """Slot of a written text: the first of the lists, in order, that knows it. lists(list, key, slot)."""
    ranked = lists.withColumn("__r", F.array_position(F.array(*[F.lit(x) for x in order]), F.col("list"))).filter("__r > 0")
    best = ranked.groupBy(F.col("key").alias("__k")).agg(F.min_by(F.struct("list", "slot"), "__r").alias("t"))
    return rows.join(best, F.lower(text) == F.col("__k"), "left").select(*rows.columns, F.col("t.list").alias("list"), F.col("t.slot").alias("slot"))


def attest(rows: DataFrame, subject: str, fields: Sequence[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Unpivot: a claim [subject, field, value] for each named field with a value that is not its default."""
    defaults = defaults or {}
    each = []
    for f in fields:
        v = F.col(f).cast("string")
        ok = v.isNotNull() & (v != "")
        if f in defaults:
            ok = ok & (v != defaults[f])
        each.append(F.when(ok, F.struct(F.lit(f).alias("relation"), v.alias("object"))))
    got = rows.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(F.array(*each))).alias("x"))
    return got.select("subject", "x.relation", "x.object")


def pair(rows: DataFrame, subject: str, values: str) -> DataFrame:
    """A claim [subject, value] for each element of a list; a value equal to its subject says nothing."""
    got = rows.select(F.col(subject).cast("string").alias("subject"), F.explode(values).alias("object"))
    return got.filter("object is not null and object <> '' and object <> subject")


def relate(rows: DataFrame, subject: str, relation: str, target: str, alone: bool = False) -> DataFrame:
    """[subject, relation, object]; with alone, [subject, relation] where nothing is named."""
    got = rows.select(F.col(subject).cast("string").alias("subject"), F.lit(relation).alias("relation"), F.nullif(F.col(target).cast("string"), F.lit("")).alias("object"))
    return got if alone else got.filter("object is not null")


def scored(rows: DataFrame, value: str, low: float, high: float, strict: bool = False) -> DataFrame:
    """Adds the score of a number on a scale; strict refuses the whole input if one is missing or off the scale."""
    v = F.col(value).cast("double")
    if strict:
        v = F.when(v.between(low, high), v).otherwise(F.raise_error(F.concat(F.lit("score off its scale: "), F.coalesce(F.col(value).cast("string"), F.lit("none")))).cast("double"))
    return rows.withColumn("score", rescale(v, low, high))
