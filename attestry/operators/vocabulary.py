"""Frozen identifier vocabularies: lists of immutable slots, keys and aliases, edges both ways, bit banks.

names(list, key): what a source writes. A list's slots are numbered once, by key order; later names are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import written


def freeze(names: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """(list, key, slot): known keys keep their slot, new ones follow in key order."""
    fresh = names.select("list", "key").distinct()
    order = Window.partitionBy("list").orderBy("key")
    if frozen is None:
        return fresh.withColumn("slot", F.row_number().over(order) - 1)
    known = frozen.select("list", "key", "slot")
    new = fresh.join(known, ["list", "key"], "left_anti")
    last = known.groupBy("list").agg(F.max("slot").alias("last"))
    added = new.withColumn("n", F.row_number().over(order)).join(last, "list", "left").select("list", "key", (F.coalesce("last", F.lit(-1)) + F.col("n")).alias("slot"))
    return known.unionByName(added)


def with_aliases(slots: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keys and their aliases' slots, to the fixpoint. aliases(list, alias, key): alias is another name of key."""
    known = frontier = slots
    pending = aliases.select("list", F.col("alias"), "key")
    while True:
        found = pending.join(frontier, ["list", "key"]).select("list", F.col("alias").alias("key"), "slot")
        frontier = written(found.join(known.select("list", "key"), ["list", "key"], "left_anti").distinct(), "aliases")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def edges_both_ways(pairs: DataFrame) -> DataFrame:
    """(list_a, key_a, list_b, key_b) and its reverse, once each."""
    back = pairs.select(F.col("list_b").alias("list_a"), F.col("key_b").alias("key_a"), F.col("list_a").alias("list_b"), F.col("key_a").alias("key_b"))
    return pairs.select("list_a", "key_a", "list_b", "key_b").unionByName(back).distinct()


def crosswalk(keys: DataFrame, edges: DataFrame, to: str) -> DataFrame:
    """Keys of other lists carried over exactly one edge into a list; a key with several edges stays unresolved (null)."""
    one = edges.filter(F.col("list_b") == to).groupBy("list_a", "key_a").agg(F.count("*").alias("n"), F.min("key_b").alias("target")).filter("n = 1")
    return keys.join(one, (F.col("list") == F.col("list_a")) & (F.col("key") == F.col("key_a")), "left").select(*keys.columns, "target")


def pack_banks(rows: DataFrame, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds mask: each field's slot packed at its (offset, width) bits."""
    mask = F.lit(0).cast("long")
    for name, (offset, width) in fields.items():
        v = F.coalesce(F.col(name).cast("long"), F.lit(0)).bitwiseAND(F.lit((1 << width) - 1))
        mask = mask.bitwiseOR(F.shiftleft(v, offset))
    return rows.withColumn("mask", mask)


def unpack_bank(mask: str, offset: int, width: int):
    return F.shiftrightunsigned(mask, offset).bitwiseAND(F.lit((1 << width) - 1))


def codepoints(spark: SparkSession, ranges: DataFrame) -> DataFrame:
    """One row per code point of ranges written as hex, `A` or `A..B`, with the range's property. ranges(span, property)"""
    lo = F.conv(F.substring_index("span", "..", 1), 16, 10).cast("long")
    hi = F.conv(F.substring_index("span", "..", -1), 16, 10).cast("long")
    return ranges.select(F.explode(F.sequence(lo, hi)).alias("cp"), "property")
