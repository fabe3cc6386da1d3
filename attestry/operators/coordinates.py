"""Coordinates of compositions: run-weighted means up the containment, and a space-filling key for locality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "m")


def mean_coordinates(containment: DataFrame, known: DataFrame) -> DataFrame:
    """(id, x, y, z, m) of parents: the mean of their children's coordinates, weighted by runs; null children are errors.

    containment(child, parent, run), known(id, x, y, z, m)"""
    rows = containment.join(known, containment.child == known.id, "left")
    bad = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no coordinate of "), F.col("child"))).cast("double"))
    weighted = [F.sum(F.coalesce(bad, F.col(a)) * F.col("run")).alias(a) for a in AXES]
    sums = rows.groupBy("parent").agg(*weighted, F.sum("run").alias("n"))
    return sums.select(F.col("parent").alias("id"), *[(F.col(a) / F.col("n")).alias(a) for a in AXES])


def climb(containment: DataFrame, atoms: DataFrame, tiers: int) -> DataFrame:
    """Coordinates of every composition, tier by tier. containment(child, parent, run, tier): tier of the parent."""
    known = atoms
    for t in range(1, tiers + 1):
        known = known.unionByName(mean_coordinates(containment.filter(F.col("tier") == t), known))
    return known


def audit(stored: DataFrame, again: DataFrame, digits: int = 9) -> DataFrame:
    """Ids whose stored coordinate differs from the recomputed one."""
    cols = ["id", *[F.round(a, digits).alias(a) for a in AXES]]
    return stored.select(*cols).exceptAll(again.select(*cols)).select("id")


def hilbert(points: np.ndarray, bits: int = 15) -> np.ndarray:
    """Index of points in [-1, 1]^d along a Hilbert curve of so many bits per axis (Skilling's transpose method)."""
    n, d = points.shape
    x = np.clip(((points + 1) / 2 * ((1 << bits) - 1)).round(), 0, (1 << bits) - 1).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def with_hilbert(points: DataFrame, bits: int = 15) -> DataFrame:
    """Adds the key by which publication is ordered."""

    @F.pandas_udf("long")
    def key(x: pd.Series, y: pd.Series, z: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([x, y, z, m], 1), bits))

    return points.withColumn("hilbert", key(*AXES))


def publication_order(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows in ranges of the key, sorted inside each."""
    return rows.repartitionByRange(partitions, "hilbert", "id").sortWithinPartitions("hilbert", "id")
