"""Benchmark decontamination: MinHash containment search with size partitions, then exact shingle containment.

An item is a few dozen 5-word shingles, a document may be 20,000 words, so their Jaccard similarity says nothing.
Items are therefore partitioned by size; for each size class a document is read through windows of twice the class
width, one width apart, so that every possible occurrence lies whole in one window of comparable size. Sets are
sketched by one-permutation MinHash (BINS bins, the least shingle hash of a bin is its value); item and window are a
candidate pair when one bin agrees. Items of fewer than SMALL shingles are not sketched, since a set of one shingle loses
its bin to a neighbour in about 1 of 512 windows: of n shingles a match may miss n - ceil(threshold n), so each document
that holds one of the item's rarest n - ceil(threshold n) + 1 (rare among the items) is a candidate, and wording that
many items share is not looked up. Every candidate is verified once: |item and document| / |item| over the whole
document, exactly.

Words are runs of letters and digits after Unicode lower-casing, so case and punctuation do not hide a leak. An item
of fewer than five words is one shingle of its own length.

The items are the query set: they travel to the tasks in blocks of at most BLOCK_SHINGLES shingles, one pass over the
documents a block. A block's result is written and its broadcast released before the next one travels, so at most one is
held at a time, however many items there are. Documents are never shuffled.

Defined results: null or empty texts and items without words match nothing; repeated rows each match; an empty table on
either side gives no rows. Items without id have no rows in leaks(), but decontaminate() heeds them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_buffer, written
from .hashing import distinct_by_row, shingles, word_hashes

BINS = 256
SMALL = 16
BLOCK_SHINGLES = 2_000_000
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


class Items:
    """Benchmark items of one block, sketched: for each shingle length, signature values and the items they belong to."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int, threshold: float = 0.8):
        raw, off = text_buffer(pc.utf8_lower(pa.array(texts, pa.string())))
        words, rows, _ = word_hashes(raw, off, BREAK)
        n_words = np.diff(rows)
        self.ids, self.width = np.array(ids, np.int64), width
        #: by shingle length: a screen, and by size class (0: not sketched) sorted values and their items
        self.parts: dict[int, tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}
        self.sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        for k in sorted({*np.minimum(n_words[n_words > 0], width).tolist()}):
            mine = np.flatnonzero(np.minimum(n_words, width) == k)
            s, p = distinct_by_row(*shingles(words, rows, int(k), "none"))
            own = {i: s[p[i] : p[i + 1]] for i in mine.tolist()}
            names, uses = np.unique(np.concatenate([*own.values(), s[:0]]), return_counts=True)
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for i, x in own.items():
                self.sets[i] = x
                if len(x) >= SMALL:
                    values, size_class = signature(x), int(len(x)).bit_length()
                else:
                    first = np.lexsort((x, uses[np.searchsorted(names, x)]))
                    values, size_class = x[first[: len(x) - max(1, math.ceil(threshold * len(x) - 1e-9)) + 1]], 0
                found.setdefault(size_class, []).append((values, np.full(len(values), i)))
            screen, tables = np.zeros(1 << 20, bool), {}
            for size_class, rows_of in found.items():
                v, o = (np.concatenate(x) for x in zip(*rows_of, strict=True))
                order = np.argsort(v, kind="stable")
                tables[size_class] = v[order], o[order]
                screen[v >> np.uint64(44)] = True
            self.parts[int(k)] = screen, tables


def signature(values: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the least value of every bin that has one. values: sorted."""
    _, first = np.unique(values % np.uint64(BINS), return_index=True)
    return np.sort(values[first])


def matches(items: Items, raw: np.ndarray, off: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shared shingles, item shingles) of each pair at the threshold or above."""
    words, rows, _ = word_hashes(raw, off, BREAK)
    for k, (screen, tables) in items.parts.items():
        s, p = shingles(words, rows, k, "none")
        close = np.flatnonzero(screen[s >> np.uint64(44)])
        tried: set[tuple[int, int]] = set()
        for size_class, (v, owners) in tables.items():
            lo, hi = np.searchsorted(v, s[close], "left"), np.searchsorted(v, s[close], "right")
            near, lo, hi = close[hi > lo], lo[hi > lo], hi[hi > lo]
            where = np.searchsorted(p, near, "right") - 1
            if size_class:  # one test an occurrence and size class, however many items share the value
                ok = np.array([_agrees(s, int(p[r]), int(p[r + 1]), at, 1 << size_class) for at, r in zip(near.tolist(), where.tolist(), strict=True)], bool)
                where, lo, hi = where[ok], lo[ok], hi[ok]
            held, whole = -1, s[:0]
            for row, a, b in sorted(set(zip(where.tolist(), lo.tolist(), hi.tolist(), strict=True))):
                for item in owners[a:b].tolist():
                    if (row, item) in tried:
                        continue
                    tried.add((row, item))
                    if held != row:
                        held, whole = row, np.unique(s[p[row] : p[row + 1]])
                    own = items.sets[item]
                    found = np.searchsorted(whole, own)
                    shared = int((whole[np.minimum(found, len(whole) - 1)] == own).sum())
                    if shared >= threshold * len(own):
                        yield row, item, shared, len(own)


def _agrees(s: np.ndarray, start: int, stop: int, at: int, width: int) -> bool:
    """Whether the shingle at this place is its bin's MinHash value in one of the two windows that hold it."""
    block = start + (at - start) // width * width
    for lo in (block - width, block):
        w = s[max(lo, start) : min(lo + 2 * width, stop)]
        if s[at] == w[w % np.uint64(BINS) == s[at] % np.uint64(BINS)].min():
            return True
    return False


def blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, threshold: float, unnamed: bool = False) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, each fetched on its own; unnamed: also items without id, as item -1."""
    total = benchmark.select(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = 1 + int(total) // (4 * BLOCK_SHINGLES)
    for i in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == i) if n > 1 else benchmark
        got = part.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toArrow()
        ids, texts = got["i"].to_pylist(), got["t"].to_pylist()
        keep = [(-1 if a is None else a, b) for a, b in zip(ids, texts, strict=True) if unnamed or a is not None]
        if keep:
            yield Items([a for a, _ in keep], [b for _, b in keep], width, threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment) whose containment reaches the threshold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    out = before = None
    for items in blocks(benchmark, item_col, text_col, width, threshold):
        if before is not None:
            out = written(out, "leaks")
            before.unpersist()
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for b in batches:
                raw, off = text_buffer(pc.utf8_lower(b["t"]))
                ids = b["i"].to_pylist()
                rows = [(ids[r], int(items.ids[i]), x, n, x / n) for r, i, x, n in matches(items, raw, off, threshold)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

        found = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)
        out, before = found if out is None else out.unionByName(found), held
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out, before = docs, None
    for items in blocks(benchmark, "item_id", "text", width, threshold, unnamed=True):
        if before is not None:
            out = written(out, "clean")
            before.unpersist()
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            for b in batches:
                raw, off = text_buffer(pc.utf8_lower(b[text_col]))
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, *_ in matches(held.value, raw, off, threshold)]] = False
                yield b.filter(pa.array(clean))

        out, before = out.mapInArrow(run, docs.schema), held
    return out
