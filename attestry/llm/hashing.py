"""Vectorised 64-bit hashing of words, word prefixes and word shingles over whole Arrow batches.

A word's hash is a polynomial in an odd base over random per-byte values, so that the hash of any slice is a
difference of two prefix sums times an inverse power. Texts are walked in pieces of CHUNK bytes; a word that
crosses a piece, however long, is carried over, so memory does not grow with a text or a word."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    steps = np.full(CHUNK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POW: np.ndarray | None = None
_INV: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None:
        _POW, _INV = _powers(_BASE), _powers(_INVERSE)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
    """Hash every maximal run of non-space bytes of every row.

    Returns (hashes, pointers into them by row, {k: hashes of the first k bytes}); a word shorter than k has the
    prefix hash 0. A word's own hash never depends on where it stands."""
    pow_, inv = _tables()
    out: list[np.ndarray] = []
    pre: dict[int, list[np.ndarray]] = {k: [] for k in prefixes}
    counts = np.zeros(len(offsets) - 1, np.int64)
    row, n_rows = 0, len(offsets) - 1
    while row < n_rows:
        last = max(int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1, row + 1)
        if offsets[last] - offsets[row] <= CHUNK:
            lo, hi = int(offsets[row]), int(offsets[last])
            h, s, p = _piece(raw[lo:hi], offsets[row:last] - lo, space, prefixes, pow_, inv)
            where = np.searchsorted(offsets[row : last + 1] - lo, s, "right") - 1
            counts[row:last] = np.bincount(where, minlength=last - row)[: last - row]
            out.append(h)
            for k in prefixes:
                pre[k].append(p[k])
        else:
            last = row + 1
            with np.errstate(over="ignore"):  # scalars wrap as arrays do
                h, p = _long(raw[int(offsets[row]) : int(offsets[last])], space, prefixes, pow_, inv)
            counts[row] = len(h)
            out.append(h)
            for k in prefixes:
                pre[k].append(p[k])
        row = last
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return mix(cat(out)), np.concatenate(([0], np.cumsum(counts))), {k: mix(cat(v)) * (cat(v) != 0) for k, v in pre.items()}


def _runs(piece: np.ndarray, starts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~space[piece]
    before = np.empty(len(piece), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty(len(piece), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    inner = starts[(starts > 0) & (starts < len(piece))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _piece(piece, starts, space, prefixes, pow_, inv):
    s, e = _runs(piece, starts, space)
    sums = np.empty(len(piece) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[piece] * pow_[: len(piece)], dtype=np.uint64, out=sums[1:])
    h = (sums[e] - sums[s]) * inv[s]
    p = {k: np.where(e - s >= k, (sums[np.minimum(s + k, e)] - sums[s]) * inv[s], np.uint64(0)) for k in prefixes}
    return h, s, p


def _long(raw, space, prefixes, pow_, inv):
    """One row of more than CHUNK bytes: the open word at the end of each piece is carried into the next."""
    hs, ps = [], {k: [] for k in prefixes}
    held, held_len, held_pre = np.uint64(0), 0, {k: np.uint64(0) for k in prefixes}
    widest = max(prefixes, default=0)
    shift = 1  # base ** held_len

    def close():
        nonlocal held, held_len, shift, held_pre
        if held_len:
            hs.append(np.array([held], np.uint64))
            for k in prefixes:
                ps[k].append(np.array([held_pre[k] if held_len >= k else 0], np.uint64))
        held, held_len, shift, held_pre = np.uint64(0), 0, 1, {k: np.uint64(0) for k in prefixes}

    zero = np.zeros(0, np.int64)
    for at in range(0, len(raw), CHUNK - widest - 1):
        piece = raw[at : at + CHUNK - widest - 1]
        s, e = _runs(piece, zero, space)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * pow_[: len(piece)], dtype=np.uint64)))
        open_front, open_back = bool(len(s)) and s[0] == 0, bool(len(e)) and e[-1] == len(piece)
        if not open_front:
            close()
        h = (sums[e] - sums[s]) * inv[s]
        p = {k: np.where(e - s >= k, (sums[np.minimum(s + k, e)] - sums[s]) * inv[s], np.uint64(0)) for k in prefixes}
        first = 0
        if open_front and held_len:
            n = int(e[0])
            for k in prefixes:
                if held_len < k:
                    take = min(k - held_len, n)
                    held_pre[k] = held_pre[k] + sums[take] * np.uint64(shift)
            held = held + h[0] * np.uint64(shift)
            held_len, shift, first = held_len + n, shift * pow(_BASE, n, 1 << 64) % (1 << 64), 1
            if not (open_back and len(e) == 1):
                close()
            else:
                continue
        stop = len(s) - 1 if open_back and len(s) > first else len(s)
        hs.append(h[first:stop])
        for k in prefixes:
            ps[k].append(p[k][first:stop])
        if stop < len(s):
            held, held_len, shift = h[stop], int(e[stop] - s[stop]), pow(_BASE, int(e[stop] - s[stop]), 1 << 64)
            held_pre = {k: (sums[min(s[stop] + k, e[stop])] - sums[s[stop]]) * inv[s[stop]] for k in prefixes}
    close()
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return cat(hs), {k: cat(v) for k, v in ps.items()}


def shingles(words: np.ndarray, rows: np.ndarray, k: int, short: str = "whole") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each row, in order, with pointers by row.

    A row of fewer than k words gives its whole sequence as one shingle ("whole") or none ("none")."""
    n = np.diff(rows)
    many = np.maximum(n - k + 1, 0)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled = mix(rolled * np.uint64(_BASE) + words[j : j + len(rolled)] + np.uint64(j + 1))
    else:
        rolled = np.zeros(0, np.uint64)
    ends = np.cumsum(many)
    at = np.repeat(rows[:-1] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    if short == "none":
        return rolled[at], np.concatenate(([0], ends))
    few = np.flatnonzero((n > 0) & (n < k))
    if not len(few):
        return rolled[at], np.concatenate(([0], ends))
    count = many.copy()
    count[few] = 1
    ptr = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(ptr[-1], np.uint64)
    full = np.ones(ptr[-1], bool)
    full[ptr[few]] = False
    out[full] = rolled[at]
    for r in few:
        h = np.zeros(1, np.uint64)
        for w in words[rows[r] : rows[r + 1]]:
            h = mix(h * np.uint64(_BASE) + w + np.uint64(97))
        out[ptr[r]] = h[0]
    return out, ptr


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, with new pointers."""
    parts = [np.unique(values[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum(n)))
