"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Channel: a writer may swap letters for look-alikes (1d10t), drop separators between letters (i.d i o t) or repeat
letters (idiiiot). A token that shows one of these becomes a character lattice; Viterbi over its states (the last two
letters) finds the likeliest letters under a trigram language model of the characters of all documents, counted by
Spark in one pass. Tokens of one batch that are equal are restored once; those that show none of these are their own
restoration and skip the lattice.

Score: a lexicon of words and word beginnings is learned from labelled rows: those that stand in toxic documents in more
different contexts (neighbouring words) than chance over all candidates would give, and almost only there. Contexts,
not documents, are counted so that a passage copied into many documents proves nothing about its words. A document's
score is the noisy-or over its distinct restored words of the share of toxic documents among those with the matched
entry; without a match it is the share of toxic ones among training documents without a match.

The lexicon is fitted on at most max_toxic + max_clean labelled rows, chosen by hash; the language model's counts cover
every document; scoring covers every whole text.

Defined results: null and empty texts score as texts without a match; labels of null are not used; repeated label rows
count once; without labelled rows of both kinds every score is 0; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_buffer
from .hashing import SPACE, mix, word_hashes

#: Byte classes of the language model: 0 everything between words, 1-26 letters, then other bytes of letters.
SIZE = 96
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[128:192] = 27 + np.arange(64)
CLASS[192:256] = 91 + np.arange(64) % 5
BREAK = CLASS == 0

PREFIXES = (3, 4, 5, 6, 7)
#: Look-alikes and the letters they may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
GAPS = " .-_*'~"
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET if ord(c) < 128]] = True
#: Look-alikes that end a word as punctuation.
_END_MARK = np.zeros(256, bool)
_END_MARK[[ord(c) for c in "!|+"]] = True
_SWAP_COST, _GAP_COST, _REPEAT_COST = 1.0, 0.5, 1.0
#: Bytes of texts whose words are held at a time; a longer text stands alone.
BLOCK = 1 << 19


@dataclass
class Model:
    """logp: trigram log probabilities; entries by kind (0: whole word, k: first k bytes): sorted hashes and log(1 - p)."""

    logp: np.ndarray
    entries: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    base: float = 0.0
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram log probabilities of byte classes, counted over all documents; SIZE ** 3 values whatever the input."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, np.int64)
        for b in batches:
            raw, off = text_buffer(pc.utf8_lower(b["t"]))
            for lo in range(0, len(raw), BLOCK):
                c = CLASS[raw[max(lo - 2, 0) : lo + BLOCK]]
                code = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
                counts += np.bincount(code, minlength=SIZE**3)
            cuts = off[1:-1]
            for at in (cuts - 1, cuts - 2):  # trigrams that span two texts
                at = at[(at >= 0) & (at + 2 < len(raw))]
                at = np.unique(at)
                c = CLASS
                np.subtract.at(counts, (c[raw[at]] * SIZE + c[raw[at + 1]]) * SIZE + c[raw[at + 2]], 1)
        kind = np.flatnonzero(counts > 0)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(counts[kind])], names=["k", "n"])

    got = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3)
    counts[got["k"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(SIZE * SIZE, SIZE)
    by_last = counts.reshape(SIZE, SIZE, SIZE).sum(0)
    back = (by_last + 0.1) / (by_last.sum(1, keepdims=True) + 0.1 * SIZE)
    smooth = (counts + 5.0 * np.tile(back, (SIZE, 1))) / (counts.sum(1, keepdims=True) + 5.0)
    return np.log(smooth).astype(np.float32)


def restore(token: str, logp: np.ndarray, best: int = 3) -> tuple[str, ...]:
    """The likeliest letter strings behind an obfuscated token, best first (Viterbi over the last two letters)."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # texts are linked from their last letter
    last = ""
    for ch in token:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def reach(state: tuple[int, int], cost: float, text: tuple | None, new=new) -> None:
            if state not in new or new[state][0] > cost:
                new[state] = cost, text

        options = LEET.get(ch, "" if ch in GAPS or not ch.isalpha() else ch)
        for (p, q), (cost, text) in states.items():
            if ch in GAPS or not options:
                reach((p, q), cost + _GAP_COST, text)
            elif ch == last:
                reach((p, q), cost + _REPEAT_COST * 0.2, text)
            for o in options:
                a, b, extra = p, q, _SWAP_COST if ch in LEET else 0.0
                for byte in o.encode():
                    c = int(CLASS[byte])
                    extra -= float(logp[a * SIZE + b, c])
                    a, b = b, c
                reach((a, b), cost + extra, (text, o))
        states, last = new, ch

    def spelt(text: tuple | None) -> str:
        out = []
        while text:
            text, o = text
            out.append(o)
        return "".join(reversed(out))

    ends = sorted((cost - float(logp[p * SIZE + q, 0]), spelt(text)) for (p, q), (cost, text) in states.items() if text)
    return tuple(dict.fromkeys(text for _, text in ends[:best]))


def _shapes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: letter; look-alike; start of a repeated code point; start of a code point."""
    n = len(raw)
    letter, leet, point = CLASS[raw] > 0, _LEET_BYTE[raw], np.ones(n, bool)
    same = np.zeros(n, bool)
    same[1:] = (raw[1:] == raw[:-1]) & (raw[1:] < 128)
    high = np.flatnonzero(raw >= 0xC0)
    if len(high):
        point = (raw & 0xC0) != 0x80
        tail = np.concatenate((raw, np.zeros(3, raw.dtype)))
        first, second, third = (tail[high + k] for k in range(3))
        euro = (first == 0xE2) & (second == 0x82) & (third == 0xAC)
        # combining marks, Latin-1 signs and general punctuation: restore() drops them as it drops ASCII signs
        two = (first == 0xCC) | (first == 0xCD) & (second < 0xB0) | (first == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA))
        three = (first == 0xE2) & ((second == 0x80) | (second == 0x81) & (third < 0xB0))
        leet[high[euro]] = True
        for k in range(3):
            letter[np.minimum(high[two & (k < 2) | three | euro] + k, n - 1)] = False
        for k in (1, 2):
            leet[np.minimum(high[euro] + k, n - 1)] = True
        width = 2 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
        again = high >= width
        for k in range(4):
            again &= (k >= width) | (tail[np.minimum(high + k, n)] == tail[high + k - width])
        same[high[again]] = True
    return letter, leet, same & (letter | leet) & ~starts, point


def _odd_tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """suspects() as (row, index of the token) by occurrence, and the distinct tokens."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    n = len(raw)
    if not n:
        return none
    solid = ~SPACE[raw]
    starts = np.zeros(n + 1, bool)
    starts[off[:-1]] = True
    starts = starts[:n]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    s = np.flatnonzero(solid & (starts | ~before))
    if not len(s):
        return none
    cut = np.minimum(np.append(s[1:], n), n)
    gap = np.flatnonzero(~solid)
    if len(gap):
        nxt = np.searchsorted(gap, s)
        cut = np.minimum(cut, np.where(nxt < len(gap), gap[np.minimum(nxt, len(gap) - 1)], n))
    row = np.searchsorted(off, s, "right") - 1

    letter, leet, again, point = _shapes(raw, starts)
    like = letter | leet
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:] = like[:-1]
    right[:-1] = like[1:]
    tail = leet & ~_END_MARK[raw] & left
    odd = np.searchsorted(s, np.flatnonzero(leet & right | tail | again), "right") - 1
    ends, heads = np.flatnonzero(like & ~right), np.flatnonzero(like & ~left)
    inner = np.searchsorted(s, heads[1:], "right") - 1
    inner = inner[inner == np.searchsorted(s, ends[:-1], "right") - 1] if len(heads) == len(ends) else inner
    token = np.unique(np.concatenate((odd, inner)))
    count = lambda x: np.concatenate(([0], np.cumsum(x)))
    sure = count(letter | (raw == 64) | (raw == 36))
    token = token[sure[cut[token]] > sure[s[token]]]

    whole = word_hashes(raw, off)[0]
    _, first, which = np.unique(whole[token], return_index=True, return_inverse=True)
    text = lambda a, b: raw[s[a] : cut[b]].tobytes().decode("utf-8", "ignore")
    texts = [text(t, t) for t in token[first].tolist()]
    rows, at = [row[token]], [which.reshape(-1)]

    points, likes = count(point), count(like & point)
    n_points, n_likes = points[cut] - points[s], likes[cut] - likes[s]
    near = np.append(False, (s[1:] - cut[:-1] <= 2) & (row[1:] == row[:-1]))
    beside = np.append(False, row[1:] == row[:-1])
    found: dict[tuple[int, int], None] = {}
    for light, close in (((n_points == 1) & (n_likes == 1), near), (n_likes <= 1, beside)):
        joined = light & np.append(False, light[:-1]) & close
        head = np.flatnonzero(light & ~joined)
        last = np.flatnonzero(light & ~np.append(joined[1:], False))
        held = count(n_likes)
        some = held[last + 1] - held[head] >= 3
        found.update(dict.fromkeys(zip(head[some].tolist(), last[some].tolist(), strict=True)))
    if found:
        rows.append(row[[a for a, _ in found]])
        at.append(np.arange(len(texts), len(texts) + len(found)))
        texts += [text(a, b) for a, b in found]
    return np.concatenate(rows), np.concatenate(at), texts


def suspects(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, str]]:
    """(row, token) of lower-case texts: tokens with a swap, separators between letters or look-alikes, or a letter or
    look-alike twice running; and runs of single ones, three or more, whose spaces and separators are then the gaps:
    the narrow runs of bare letters at most two spaces apart, and the wide ones of all that stand together.

    A separator is what restore() drops. Tokens without a letter, @ or $ are numbers and signs."""
    rows, at, texts = _odd_tokens(raw, off)
    for r, t in zip(rows.tolist(), at.tolist(), strict=True):
        yield r, texts[t]


def _restored(token: str, model: Model) -> tuple[str, ...]:
    token = token.strip(".,;:?!\"'()[]{}*~-_") if not token[-1:] == "$" else token.strip(".,;:?\"'()[]{}*~-_")
    got = model.cache.get(token)
    if got is None:
        if len(model.cache) > 50_000:
            model.cache.clear()
        got = tuple(x for x in restore(token, model.logp) if x != token)  # an ordinary word is counted as it stands
        if len(token) < 64:
            model.cache[token] = got
    return got


def _features(texts: pa.Array, model: Model, kinds: Iterable[int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Hashes of words by kind, restored words last, and the row of each word."""
    raw, off = text_buffer(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    kinds = tuple(kinds)
    whole, rows, parts = word_hashes(raw, off, BREAK, tuple(k for k in kinds if k))
    owner = np.repeat(np.arange(len(texts)), np.diff(rows))
    odd_row, odd_token, tokens = _odd_tokens(raw, off)
    readings = [_restored(t, model) for t in tokens]
    words = [w for r in readings for w in r]
    if words:
        raw, off = text_buffer(pa.array(words, pa.large_string()))
        more, more_rows, more_parts = word_hashes(raw, off, BREAK, tuple(k for k in kinds if k))
        place = more_rows[np.concatenate(([0], np.cumsum([len(r) for r in readings])))]  # distinct tokens to their words
        size = np.diff(place)[odd_token]
        use = np.repeat(place[odd_token] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.concatenate((owner, np.repeat(odd_row, size)))
        whole = np.concatenate((whole, more[use]))
        parts = {k: np.concatenate((parts[k], more_parts[k][use])) for k in parts}
    return {k: parts[k] if k else whole for k in kinds}, owner


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows whose texts have at most BLOCK bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(ends):
        hi = max(int(np.searchsorted(ends, ends[lo] - size[lo] + BLOCK, "right")), lo + 1)
        yield lo, hi
        lo = hi


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The scores of texts, a block of them at a time."""
    if not model.entries or not len(texts):
        return np.full(len(texts), model.base)
    return np.concatenate([_block_scores(texts.slice(lo, hi - lo), model) for lo, hi in _blocks(texts)])


def _block_scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(texts), model.base)
    found, owner = _features(texts, model, model.entries)
    rows, words, logs = [], [], []
    for kind, (hashes, log_not) in model.entries.items():
        at = np.minimum(np.searchsorted(hashes, found[kind]), len(hashes) - 1)
        hit = hashes[at] == found[kind]
        rows.append(owner[hit])
        words.append(hashes[at[hit]])
        logs.append(log_not[at[hit]])
    rows, words, logs = np.concatenate(rows), np.concatenate(words), np.concatenate(logs)
    if len(rows):
        _, first = np.unique(mix(words + mix(rows.astype(np.uint64))), return_index=True)
        total = np.bincount(rows[first], logs[first], minlength=len(texts))
        hit = total < 0
        out[hit] = 1 - (1 - model.base) * np.exp(total[hit])
    return out


def _contexts(texts: pa.Array, model: Model, kinds: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block of texts and kind: each word's hash, its text, and a hash of the words beside it."""
    for lo in range(0, len(texts), 128):
        found, owner = _features(texts[lo : lo + 128], model, (0, *kinds))
        beside = mix(np.roll(found[0], 1) + mix(np.roll(found[0], -1)))
        for k in kinds:
            ok = found[k] != 0
            yield k, found[k][ok], (lo + owner[ok]).astype(np.int32), beside[ok]


def _documents(names: np.ndarray, value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """In how many of n documents each of the sorted names occurs."""
    at = np.minimum(np.searchsorted(names, value), len(names) - 1)
    hit = names[at] == value
    pairs = np.unique(at[hit].astype(np.int64) * n + doc[hit])
    return np.bincount(pairs // n, minlength=len(names)).astype(float)


def _lexicon(texts: pa.Array, toxic: np.ndarray, model: Model, weight: float, purity: float) -> None:
    """Words and beginnings in more contexts of toxic documents than chance gives, and almost only there.

    One kind at a time, so that the driver holds the words of one kind of the bounded sample."""
    kinds = (0, *PREFIXES)
    n, bad, good = len(texts), texts.filter(pa.array(toxic)), texts.filter(pa.array(~toxic))
    base = toxic.sum() / (toxic.sum() + weight * (~toxic).sum())
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    candidates = 0
    for k in kinds:
        parts = [x[1:] for x in _contexts(bad, model, (k,))]
        value, doc, beside = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first = np.unique(mix(value + mix(beside)), return_index=True)
        names, contexts = np.unique(value[first], return_counts=True)
        candidates += len(names)
        often = contexts >= 4
        if often.any():
            found[k] = names[often], contexts[often], _documents(names[often], value, doc, n)
    least = max(4, int(np.ceil((np.log(max(candidates, 2)) + 2.3) / -np.log(min(base, 0.5)))))
    found = {k: tuple(x[c >= least] for x in (names, c, total)) for k, (names, c, total) in found.items() if (c >= least).any()}
    clean = {k: np.zeros(len(x[0])) for k, x in found.items()}
    for k, value, doc, _ in _contexts(good, model, tuple(found)):
        clean[k] += weight * _documents(found[k][0], value, doc, n)
    for k, (names, _, total) in found.items():
        pure = total >= purity * (total + clean[k])
        if pure.any():
            model.entries[k] = names[pure], np.log((clean[k][pure] + 0.5) / (total[pure] + clean[k][pure] + 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 2000, max_clean: int = 6000, purity: float = 0.95) -> Model:
    """labels: the rows to learn from. The sample is bounded by max_toxic and max_clean, and chosen by hash."""
    bounded_batches(docs.sparkSession)
    model = Model(language_model(docs, text_col))
    marked = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    size = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    part = [marked.filter(test).orderBy(F.xxhash64("i"), "i").limit(n) for test, n in (("y = 1", max_toxic), ("y = 0", max_clean))]
    sample = F.broadcast(part[0].unionByName(part[1]))  # at most max_toxic + max_clean rows of two numbers
    got = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).join(sample, "i")
    # of rows that share an id the one of least text hash counts, whatever the order of tasks
    got = got.groupBy("i").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.min("y").alias("y")).toArrow()
    order = np.argsort(got["i"].to_numpy(), kind="stable")
    texts, y = got["t"].combine_chunks().take(pa.array(order)), got["y"].to_numpy()[order]
    del got
    toxic = y == 1
    if not toxic.any() or toxic.all():
        return model
    weight = (size.get(0, 0) / (~toxic).sum()) / (size[1] / toxic.sum())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _lexicon(texts, toxic, model, max(1.0, weight), purity)
    hit = np.concatenate([scores(texts[lo : lo + 256], model) for lo in range(0, len(texts), 256)]) > 0.5
    model.base = float((toxic & ~hit).sum() + 0.1) / float((~hit).sum() + 1) * 0.5
    model.cache = {}
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document, from the whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(scores(b["t"], held.value))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b[text_col], held.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
