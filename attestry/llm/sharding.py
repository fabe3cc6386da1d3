"""Sharding over fixed virtual slots, with a versioned slot-to-shard map.

A record's id is hashed into one of SLOTS virtual slots, for good. Which shard owns a slot is written in a map; the map
for n shards follows from the map for n - 1: the new shard takes its share of slots from the shards that own most, and
nothing else moves. Bytes are summed per slot, and rebalance() edits a copy of the map under the next version number by
moving slots from the heaviest to the lightest shard. The map and the sums have SLOTS rows, whatever the input.

Places inside a shard are gapless. They are a prefix sum over (slot, lane) counts plus a rank inside that pair; a row's
lane is its input partition's remainder by the number of lanes, one for each LANE_ROWS rows of the table. So even an id
that a third of all rows share is numbered in lanes, and the counts are SLOTS rows a lane, however many partitions.

Defined results: null text has no bytes and the CRC of the empty string; null ids share one slot; repeated rows each
get a place; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SLOTS = 4096
LANE_ROWS, LEAST_LANES = 16_000_000, 8


def grow(owners: Sequence[int], shards: int) -> list[int]:
    """The map for shards + 1: the new shard takes SLOTS // (shards + 1) slots, one at a time, from the fullest shard."""
    owners = list(owners)
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    for slot, k in enumerate(owners):
        held[k].append(slot)
    for _ in range(len(owners) // (shards + 1)):
        fullest = max(held, key=lambda k: (len(held[k]), -k))
        owners[held[fullest].pop()] = shards
    return owners


def owners_of(shards: int, slots: int = SLOTS) -> list[int]:
    """The map that the number of shards alone decides."""
    owners = [0] * slots
    for n in range(1, shards):
        owners = grow(owners, n)
    return owners


def rebalance(owners: Sequence[int], slot_bytes: Sequence[int], shards: int, slack: float = 0.02, moves: int = SLOTS) -> list[int]:
    """A copy of the map with slots moved from the heaviest to the lightest shard until both are within the slack."""
    owners = list(owners)
    load = [0] * shards
    for slot, k in enumerate(owners):
        load[k] += slot_bytes[slot]
    for _ in range(moves):
        top, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[top] - load[low]
        fit = [s for s, k in enumerate(owners) if k == top and 0 < slot_bytes[s] < gap]
        if gap <= slack * sum(load) / shards or not fit:
            break
        best = min(fit, key=lambda s: (abs(slot_bytes[s] - gap / 2), s))
        owners[best] = low
        load[top], load[low] = load[top] - slot_bytes[best], load[low] + slot_bytes[best]
    return owners


def map_table(spark: SparkSession, versions: dict[int, Sequence[int]]) -> DataFrame:
    """(version, vslot, owner)"""
    rows = [(v, s, k) for v, owners in versions.items() for s, k in enumerate(owners)]
    return spark.createDataFrame(rows, "version int, vslot int, owner int")


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, part): rows with their virtual slot and input partition, written once."""
    text = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    return written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SLOTS)).cast("int").alias("vslot"),
            F.spark_partition_id().alias("part"),
        ),
        "placed",
    )


def slot_bytes(placed: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): SLOTS rows at most."""
    return placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def store_map(placed: DataFrame, versions: dict[int, Sequence[int]]) -> DataFrame:
    """Write the versions of the map with each slot's bytes and rows: (version, vslot, owner, bytes, rows)."""
    sums = slot_bytes(placed)
    return written(map_table(placed.sparkSession, versions).join(sums, "vslot", "left").fillna(0, ["bytes", "rows"]), "slot-map")


def edit_map(stored: DataFrame, version: int, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a stored map, rebalanced by bytes; SLOTS rows pass through the driver, whatever the input."""
    rows = sorted(stored.filter(F.col("version") == version).select("vslot", "owner", "bytes").collect())
    owners = rebalance([r["owner"] for r in rows], [r["bytes"] for r in rows], shards, slack)
    spark = stored.sparkSession
    new = map_table(spark, {version + 1: owners}).join(stored.filter(F.col("version") == version).select("vslot", "bytes", "rows"), "vslot")
    return written(stored.unionByName(new), "slot-map")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The law `key`: id and shard count decide. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot."""
    spark = docs.sparkSession
    owners = owners_of(shards)
    placed = place(docs, id_col, text_col)
    stored = store_map(placed, {shards: owners, shards + 1: grow(owners, shards)})
    maps = stored.groupBy("vslot").pivot("version", [shards, shards + 1]).agg(F.first("owner")).toDF("vslot", "shard", "grown_shard")
    lanes = max(LEAST_LANES, -(-placed.count() // LANE_ROWS))
    placed = placed.withColumn("part", F.pmod("part", F.lit(lanes)))
    counts = written(placed.groupBy("vslot", "part").agg(F.count("*").alias("n")), "slot-counts")
    whole = counts.groupBy("vslot").agg(F.sum("n").alias("rows")).join(maps, "vslot")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")  # SLOTS rows in all
    inside = F.sum("n").over(Window.partitionBy("vslot").orderBy("part")) - F.col("n")
    starts = counts.withColumn("inside", inside).join(whole.withColumn("before", before), "vslot")
    starts = written(starts.select("vslot", "part", "shard", "grown_shard", (F.col("before") + F.col("inside")).alias("start")), "slot-starts")
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("rank", rank).join(starts, ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard", "vslot"
    )
