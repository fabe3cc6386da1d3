"""Exact dedup over a cuckoo-filter index of live digests.

The index holds one entry per live digest: the digest of the normalised text (the bucketed content, by which a filter
hit is verified), the row that stays, and counts. It is a cuckoo filter of 16-bit fingerprints whose slots also name the
stored entry: a lookup reads two buckets; no equal fingerprint there means "surely new", and nothing else is read or
compared; an equal one is verified against the digest stored under that slot. When the filter overflows, it is rebuilt at
twice the size from the stored keys. Entries can be deleted again. There is no other lookup structure.

Copies are folded inside each input task first, so a group of any size, even a third of all rows, reaches the index as
one partial entry per task (and FOLD_ENTRIES new digests); the index is dealt by digest into as many parts as the counted
rows need at PART_ENTRIES each, so a task's memory does not grow with the table. The decision joins back on the digest,
where adaptive execution may split a hot key.

Defined results: null text counts as empty; equal (id, text) rows are copies of each other and exactly one stays; null
ids rank below every id; an empty table gives an empty result; other columns, whatever their names, are not touched."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, in_table
from .common import bounded_batches, free_name, text_buffer, written


#: Digests that an input task folds before it hands them on, and rows of one part of the index.
FOLD_ENTRIES = 1 << 18
PART_ENTRIES = 1 << 20


class CuckooFilter:
    """Partial-key cuckoo filter: four slots a bucket, two buckets a key; a slot holds a 16-bit fingerprint (0: free) and
    the number of the entry it stands for. insert() is False when it is full."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.marks = array("H", bytes(2 * self.SLOTS * (self.mask + 1)))
        self.entry = array("i", bytes(4 * self.SLOTS * (self.mask + 1)))
        self.turn = 0

    def _place(self, key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:2], "little") or 1, int.from_bytes(key[2:10], "little") & self.mask

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & self.mask

    def slots(self, key: bytes) -> list[int]:
        """The slots that hold the key's fingerprint in its two buckets."""
        mark, at = self._place(key)
        other, marks, found = self._other(at, mark), self.marks, []
        for bucket in (at,) if at == other else (at, other):
            lo = bucket * 4
            if mark in marks[lo : lo + 4]:
                found += [i for i in range(lo, lo + 4) if marks[i] == mark]
        return found

    def __contains__(self, key: bytes) -> bool:
        return bool(self.slots(key))

    def insert(self, key: bytes, entry: int = 0) -> bool:
        mark, at = self._place(key)
        marks, held = self.marks, self.entry
        for bucket in (at, self._other(at, mark)):
            lo = bucket * 4
            if 0 in marks[lo : lo + 4]:
                i = marks.index(0, lo, lo + 4)
                marks[i], held[i] = mark, entry
                return True
        at, undo = self._other(at, mark), []
        for _ in range(self.KICKS):
            self.turn = (self.turn + 1) % self.SLOTS
            i = at * 4 + self.turn
            undo.append((i, marks[i], held[i]))
            marks[i], held[i], mark, entry = mark, entry, marks[i], held[i]
            at = self._other(at, mark)
            lo = at * 4
            if 0 in marks[lo : lo + 4]:
                i = marks.index(0, lo, lo + 4)
                marks[i], held[i] = mark, entry
                return True
        for i, old, number in reversed(undo):
            marks[i], held[i] = old, number
        return False

    def delete(self, key: bytes, entry: int | None = None) -> bool:
        """Frees one slot with the key's fingerprint, that of the entry if one is named."""
        for i in self.slots(key):
            if entry is None or self.entry[i] == entry:
                self.marks[i] = 0
                return True
        return False


class LiveDigests:
    """Entries behind a cuckoo filter: digests end to end, and the row that stays (has id, id, row), n and same of each."""

    WIDTH = 32

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.content = bytearray()
        self.numbers = {k: array("q") for k in ("has", "id", "row", "n", "same")}
        self.free: list[int] = []
        self.resizes = self.verified = 0

    def __len__(self) -> int:
        return len(self.content) // self.WIDTH - len(self.free)

    def _key(self, entry: int) -> bytes:
        return bytes(self.content[entry * self.WIDTH : (entry + 1) * self.WIDTH])

    def find(self, digest: bytes) -> int | None:
        """The digest's entry: only slots with its fingerprint are compared with stored content."""
        for slot in self.filter.slots(digest):
            self.verified += 1
            entry = self.filter.entry[slot]
            if self._key(entry) == digest:
                return entry
        return None

    def _live(self) -> Iterator[int]:
        gone = set(self.free)
        return (e for e in range(len(self.content) // self.WIDTH) if e not in gone)

    def _grow(self) -> None:
        size = 2 * (self.filter.mask + 1)
        while True:
            bigger = CuckooFilter(size)
            if all(bigger.insert(self._key(e), e) for e in self._live()):
                self.filter, self.resizes = bigger, self.resizes + 1
                return
            size *= 2

    def insert(self, digest: bytes, keep: tuple, n: int, same: int) -> None:
        col, entry = self.numbers, self.find(digest)
        if entry is None:
            if self.free:
                entry = self.free.pop()
                self.content[entry * self.WIDTH : (entry + 1) * self.WIDTH] = digest
                for k, v in zip(("has", "id", "row", "n", "same"), (*keep, n, same), strict=True):
                    col[k][entry] = v
            else:
                entry = len(self.content) // self.WIDTH
                self.content += digest
                for k, v in zip(("has", "id", "row", "n", "same"), (*keep, n, same), strict=True):
                    col[k].append(v)
            if not self.filter.insert(digest, entry):
                self._grow()
            return
        col["n"][entry] += n
        known = (col["has"][entry], col["id"][entry], col["row"][entry])
        if keep[:2] == known[:2]:
            col["same"][entry] += same
            col["row"][entry] = max(keep[2], known[2])
        elif keep > known:
            col["has"][entry], col["id"][entry], col["row"][entry] = keep
            col["same"][entry] = same

    def delete(self, digest: bytes) -> bool:
        entry = self.find(digest)
        if entry is None:
            return False
        self.free.append(entry)
        return self.filter.delete(digest, entry)

    def entries(self) -> Iterator[tuple]:
        """(digest, (has id, id, row), n, same)"""
        col = self.numbers
        return ((self._key(e), (bool(col["has"][e]), col["id"][e], col["row"][e]), col["n"][e], col["same"][e]) for e in self._live())


ENTRY = "digest binary, keep_id long, keep_row long, group_size long, same long"
_FIELDS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("same", pa.int64())])


def _emit(live: LiveDigests, size: int = 8192) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for digest, (has_id, doc, row), n, same in live.entries():
        rows.append((digest, doc if has_id else None, row, n, same))
        if len(rows) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS, strict=True)], schema=_FIELDS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS, strict=True)], schema=_FIELDS)


def _rank(doc: int | None, row: int) -> tuple:
    return (int(doc is not None), doc if doc is not None else 0, row)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    live = LiveDigests()
    for b in batches:
        for digest, doc, row in zip(b["digest"].to_pylist(), b["id"].to_pylist(), b["row"].to_pylist(), strict=True):
            live.insert(digest, _rank(doc, row), 1, 1)
            if len(live) == FOLD_ENTRIES:
                yield from _emit(live)
                live = LiveDigests()
    yield from _emit(live)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    live = LiveDigests()
    for b in batches:
        for op, digest, doc, row, n, same in zip(*(b[c].to_pylist() for c in ("op", "digest", "keep_id", "keep_row", "group_size", "same")), strict=True):
            if op == 1:
                live.delete(digest)
            else:
                live.insert(digest, _rank(doc, row), n, same)
    yield from _emit(live)


def _digest_column(column: pa.Array) -> pa.Array:
    raw, off = text_buffer(pc.ascii_lower(column))
    view, ends = memoryview(raw), off.tolist()
    return pa.array([hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row): the SHA-256 of the text with A-Z lower-cased; row numbers are fixed by writing the table."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], _digest_column(b["text"])], names=["id", "digest"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, digest binary")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def build_index(rows: DataFrame) -> DataFrame:
    """One entry per live digest from digests()."""
    return update_index(None, rows)


def update_index(index: DataFrame | None, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Apply deletions (rows with a digest), then insertions (rows of digests()) to an index, and write the new one."""
    parts = []
    if index is not None:
        parts.append(index.withColumn("op", F.lit(0)))
    if deleted is not None:
        none = F.lit(None).cast("long")
        parts.append(deleted.select("digest", none.alias("keep_id"), none.alias("keep_row"), none.alias("group_size"), none.alias("same"), F.lit(1).alias("op")))
    if inserted is not None:
        parts.append(inserted.mapInArrow(_fold, ENTRY).withColumn("op", F.lit(2)))
    ops = parts[0]
    for p in parts[1:]:
        ops = ops.unionByName(p)
    parts = -(-sum(x.count() for x in (index, inserted, deleted) if x is not None) // PART_ENTRIES)  # of written tables
    return written(ops.repartition(max(1, parts), "digest").sortWithinPartitions("op").mapInArrow(_merge, ENTRY), "live-digests")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    index = build_index(rows)
    return rows.join(index, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = digests(docs, id_col, text_col)
    index = build_index(rows)
    mark = free_name(docs, "__digest")
    schema = docs.schema
    # texts stay where they are: a bit table of the digests of groups in which rows go, of bounded size, tells which rows
    # surely stay; the others are looked up exactly
    first = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    gone = rows.join(index, "digest").filter("not id <=> keep_id").select(F.col("digest").alias(f"{mark}k"), F.col("id").alias(f"{mark}i"), first.alias("h"))
    lost = written(gone, "lost-digests")
    again = written(index.filter("same > 1").select(F.col("digest").alias(f"{mark}k"), F.col("keep_id").alias(f"{mark}i"), first.alias("h")), "repeated-rows")
    held = bit_table(lost.select("h").unionByName(again.select("h")), F.col("h"))

    def run(batches):
        for b in batches:
            digest = _digest_column(b[text_col])
            heads = np.array([int.from_bytes(d[:8], "big", signed=True) for d in digest.to_pylist()], np.int64)
            yield b.append_column(mark, digest).append_column(f"{mark}m", in_table(held, heads))

    marked = docs.mapInArrow(run, type(schema)(list(schema.fields)).add(mark, "binary").add(f"{mark}m", "boolean"))
    own = (F.col(mark) == F.col(f"{mark}k")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{mark}i"))
    kept = marked.filter(f"{mark}m").join(lost.drop("h"), own, "left_anti")
    if not again.isEmpty():  # the very same row occurs again: one of them stays
        same = again.drop("h")
        kept = kept.join(same, own, "left_anti").unionByName(kept.join(same, own, "left_semi").dropDuplicates([id_col, mark]))
    return marked.filter(f"not {mark}m").unionByName(kept).select(*docs.columns)
