"""Best-fit packing of token sequences under several capacities at once (vector best-fit).

A document is its token ids and an end id. One longer than a sequence is cut into full pieces and a shorter first one.
A piece has a vector of costs: tokens, one document, and attention cost (tokens squared); a bin has a residual of each,
and takes a piece only if every residual holds it. Pieces go in decreasing size; among the bins that can take one, the
one with the least weighted norm of residuals after the placement wins ("norm"), or the one whose residual has the
greatest weighted dot product with the piece's vector ("dot"). All three limits bind by default: no sequence of several
pieces holds more documents than DOCUMENTS times the mean, nor costs more attention than ATTENTION of one full piece. A
piece that alone costs more than a limit is a sequence of its own. Weights let tokens decide first, so that the number of
sequences stays within a thousandth or two of the least (README).

Scale: tokens never meet in one place; only piece rows (ids, lengths) are shuffled, by hash, and each task packs them
in windows of WINDOW pieces, so memory is bounded however a key is repeated. A full piece is a sequence of its own.

Defined results: null text is empty, so its document is the end id alone; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

WINDOW = 16_384
#: Default limits: documents a sequence, as a multiple of the mean pieces a sequence (at least LEAST_DOCUMENTS), and the
#: attention cost of a shared sequence, as a share of a full piece's.
DOCUMENTS, LEAST_DOCUMENTS, ATTENTION = 16, 32, 0.99


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a file of the tokenizers library, no special tokens added.

    Plain byte-level BPE, whose file says nothing beyond its vocabulary, runs in tiktoken's merge loop, which gives the
    same ids four times faster: without normaliser, with the published split, and with merges in the order of the ids,
    the pair of least id is the first merge that applies. Any other file, and a text that holds one of the file's added
    tokens, goes through tokenizers itself."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_library(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain(spec):
        return by_library
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    # fixed value: the split pattern of byte-level BPE as published with that vocabulary
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(a in text for a in added):
            return by_library(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def _plain(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE whose vocabulary alone decides the ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    made = {t for t in model["vocab"] if len(t) > 1 and t not in added}
    return all(a < b for a, b in zip(merged[:-1], merged[1:], strict=True)) and len(merged) == len(made) and (not merged or merged[0] >= 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece."""
    bounded_batches(docs.sparkSession)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 6 if with_ids else 5]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b["i"].to_pylist(), b["t"].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    own = ids[lo:hi]
                    out.append((doc, k, lo, hi - lo, zlib.crc32(own.tobytes()), own.tolist())[: len(types)])
            cols = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def best_fit(costs: np.ndarray, capacity: np.ndarray, rule: str = "norm", weights: np.ndarray | None = None) -> np.ndarray:
    """Bin of each piece. costs: pieces x resources; a piece above a capacity gets a bin of its own. Of bins with equal
    values the oldest wins."""
    w = np.ones(len(capacity)) if weights is None else weights
    order = np.lexsort((np.arange(len(costs)), -(costs / capacity * w).max(1)))
    where = np.empty(len(costs), np.int64)
    room = np.empty((64, len(capacity)))
    names = np.empty(64, np.int64)
    n_open = n_bins = 0
    for i in order:
        c = costs[i]
        if (c > capacity).any():
            where[i], n_bins = n_bins, n_bins + 1
            continue
        pick = -1
        if n_open:
            left = room[:n_open] - c
            ok = np.flatnonzero((left >= 0).all(1))
            if len(ok):
                value = (((left[ok] / capacity) ** 2) * w).sum(1) if rule == "norm" else -(room[ok] / capacity * (c / capacity) * w).sum(1)
                ok = ok[value == value.min()]
                pick = int(ok[names[ok].argmin()])
        if pick < 0:
            if n_open == len(room):
                room, names = np.concatenate((room, np.empty_like(room))), np.concatenate((names, np.empty_like(names)))
            room[n_open], names[n_open], pick = capacity, n_bins, n_open
            n_open, n_bins = n_open + 1, n_bins + 1
        room[pick] -= c
        where[i] = names[pick]
        if (room[pick] <= 0).any():  # full: the last open bin takes its place
            n_open -= 1
            room[pick], names[pick] = room[n_open], names[n_open]
    return where


def pack(found: DataFrame, capacity: int = 2048, max_documents: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> DataFrame:
    """pieces() with sequence_id and offset. Limits of None are the defaults above."""
    count, tokens = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    mean = count * capacity / max(1, tokens)
    limits = np.array([capacity, max_documents or max(LEAST_DOCUMENTS, int(np.ceil(DOCUMENTS * mean))), max_attention or ATTENTION * capacity**2], float)
    n = max(1, -(-count // WINDOW))
    schema = found.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            held, size = [*held, b], size + b.num_rows
            if size >= WINDOW:
                base = yield from _window(held, base)
                held, size = [], 0
        if size:
            yield from _window(held, base)

    def _window(held: list[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        length = t["length"].to_numpy()
        bins = best_fit(np.stack((length, np.ones(len(length)), length.astype(float) ** 2), 1), limits, rule, np.array(weights))
        order = np.lexsort((np.arange(len(bins)), bins))
        sizes = length[order]
        ends = np.cumsum(sizes)
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - sizes - np.maximum.accumulate(np.where(first, ends - sizes, 0))
        out = t.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=4096)
        return base + int(bins.max()) + 1

    dealt = found.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions("length", "doc_id", "piece")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **limits) -> DataFrame:
    """Tokenise, cut and pack; pieces are written once in between, as counting them must not tokenise again."""
    return pack(written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity, **limits)
