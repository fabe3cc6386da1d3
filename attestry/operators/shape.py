"""Geometry: nearest neighbours, centroids, and distances of trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A block of query vectors that travels to every task: the proven bound of what is broadcast.
BLOCK_BYTES = 32 << 20

#: Distances a task holds at once: so many queries by so many vectors.
TILE_QUERIES, TILE_VECTORS = 512, 2048


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors of every query by Euclidean distance, without itself: (query, id, dist, rank).

    Queries travel in blocks of bounded size; every task keeps its own k best per query, so what is shuffled is k rows
    per query and task."""
    first = queries.select(F.size(vec_col)).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "query long, id long, dist double, rank int")
    per_block = max(1, BLOCK_BYTES // (8 * max(1, first[0])))
    n = -(-queries.count() // per_block)
    out = None
    for i in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64(id_col), F.lit(n)) == i)
        rows = part.select(id_col, vec_col).toPandas()
        ids, block = rows[id_col].to_numpy(np.int64), np.stack(rows[vec_col].to_list()).astype(np.float64)

        def scan(batches: Iterator[pd.DataFrame], ids=ids, block=block) -> Iterator[pd.DataFrame]:
            best_d, best_i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
            norms = (block * block).sum(1)
            for b in batches:
                for v in range(0, len(b), TILE_VECTORS):
                    part = b.iloc[v : v + TILE_VECTORS]
                    x, own = np.stack(part[vec_col].to_list()).astype(np.float64), part[id_col].to_numpy(np.int64)
                    squares = (x * x).sum(1)
                    for t in range(0, len(ids), TILE_QUERIES):
                        tile = slice(t, t + TILE_QUERIES)
                        # a product tells which vectors may be among the best, with room for its rounding; only they are measured
                        near = norms[tile, None] + squares[None, :] - 2 * (block[tile] @ x.T)
                        room = 1e-9 * (norms[tile, None] + squares[None, :])
                        other = ids[tile, None] != own[None, :]
                        kth = np.partition(np.where(other, near + room, np.inf), k - 1, axis=1)[:, k - 1 : k] if k <= len(own) else np.inf
                        r, c = np.nonzero(other & (near - room <= np.minimum(kth, best_d[tile, k - 1 : k])))
                        if len(r):
                            d = np.concatenate([((x[c[s : s + 65536]] - block[t + r[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(r), 65536)])
                            rows = np.unique(r)
                            rr = np.concatenate((r, np.repeat(rows, k)))
                            dd, ii = np.concatenate((d, best_d[t + rows].reshape(-1))), np.concatenate((own[c], best_i[t + rows].reshape(-1)))
                            order = np.lexsort((ii, dd, rr))
                            rr, dd, ii = rr[order], dd[order], ii[order]
                            start = np.searchsorted(rr, rows)
                            take = start[:, None] + np.arange(k)[None, :]
                            best_d[t + rows], best_i[t + rows] = dd[take], ii[take]
            flat = best_d.reshape(-1)
            ok = np.isfinite(flat)
            yield pd.DataFrame({"query": np.repeat(ids, k)[ok], "id": best_i.reshape(-1)[ok], "dist": np.sqrt(flat[ok])})

        found = vectors.select(id_col, vec_col).mapInPandas(scan, "query long, id long, dist double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy("dist", "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, group: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group: (group, dim, mean), pre-aggregated before the shuffle."""
    return vectors.select(group, F.posexplode(vec_col).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for i in range(len(a)):
        for j in range(len(b)):
            before = [d[i - 1, j]] * (i > 0) + [d[i, j - 1]] * (j > 0) + [d[i - 1, j - 1]] * (i > 0 and j > 0)
            if before:
                d[i, j] = max(d[i, j], min(before))
    return float(d[-1, -1])


def frechet_outliers(a: np.ndarray, b: np.ndarray, skips: int) -> float:
    """Discrete Frechet distance when so many points of a may be left out."""
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    n, m = d.shape
    best = np.full((n + 1, m + 1, skips + 1), np.inf)
    best[0, 0, :] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            for s in range(skips + 1):
                if i and s:
                    best[i, j, s] = min(best[i, j, s], best[i - 1, j, s - 1])
                if i and j:
                    before = min(best[i - 1, j - 1, s], best[i - 1, j, s] if j else np.inf, best[i, j - 1, s])
                    best[i, j, s] = min(best[i, j, s], max(before, d[i - 1, j - 1]))
    return float(best[n, m].min())


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping, divided by the steps of the path."""
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    steps = np.zeros(cost.shape)
    cost[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x, y = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
            cost[i, j], steps[i, j] = cost[x, y] + d[i - 1, j - 1], steps[x, y] + 1
    return float(cost[-1, -1] / steps[-1, -1])


def edr(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """Edit distance on real sequences."""
    near = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) <= tolerance
    row = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, len(b) + 1):
            new[j] = min(row[j - 1] + (not near[i - 1, j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row[-1])


def trajectory_distances(pairs: DataFrame, measure: str = "frechet", parameter: float = 1.0) -> DataFrame:
    """Distance of each pair of trajectories: pairs(a_id, b_id, a array<array<double>>, b ...) -> (a_id, b_id, distance)."""
    by_name = {"frechet": frechet, "outliers": lambda a, b: frechet_outliers(a, b, int(parameter)), "dtw": dtw, "edr": lambda a, b: edr(a, b, parameter)}
    run = by_name[measure]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [float(run(np.array(list(map(list, x)), float), np.array(list(map(list, y)), float))) if len(x) and len(y) else None for x, y in zip(b["a"], b["b"], strict=True)]
            yield pd.DataFrame({"a_id": b["a_id"], "b_id": b["b_id"], "distance": d})

    return pairs.mapInPandas(each, "a_id long, b_id long, distance double")
