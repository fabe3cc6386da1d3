"""N-gram Jaccard self-join, size-aware: subsets for small sets, inverted lists for large ones, boundary by cost.

1. Profile. Every text becomes the set of its distinct word shingles, as 64-bit hashes. Equal sets form one class, so
   copies cost one row each and no pair. The same pass counts shingles over all documents in a table of counters, sized
   by the size of the input between two bounds (SKETCH); they order shingles from rare to common. Any order gives the same links; this one gives short lists.
2. Small sets (both sizes up to the boundary): for sizes s <= t a link needs c(s, t) common shingles, so every subset
   of exactly c shingles is enumerated and sets that share one are linked; all members of such a group are linked to
   one member of size s.
3. Large sets (the larger size above the boundary): inverted lists over each set's rarest s - ceil(T s) + 1 shingles;
   two linked sets share one of them, within the size and position bounds. Each list is first scanned against the
   member that has it earliest, giving one pair per entry. After components of what is verified, only pairs from
   different components are still compared, so a group of thousands of near copies is not expanded into its pairs,
   and yet no link between components is missed.
4. The boundary is the size up to which enumerating subsets, over the counted sizes, costs less than scanning lists.
5. Candidates whose parity bitmaps already differ in more places than linked sets can differ are dropped (a bit is the
   parity of a set's shingles that fall on it, so bitmaps differ in at most as many bits as sets in shingles). Every
   other candidate is verified on the whole sets: exact intersection, exact size test in integers. Only the texts of
   classes in such pairs move; a pass over all texts picks them by a bit table of their ids.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are their own component;
texts of fewer words than a shingle have one shingle, the whole sequence; repeated rows fall in one class; texts that
only rows without an id have are linked with their equals alone; an empty table gives an empty result; columns other
than id and text are not read."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, in_table, power_of_two
from .common import bounded_batches, free_name, text_buffer, written
from .components import components
from .hashing import LOWER, distinct_by_row, mix, shingles, word_hashes

#: Least and greatest number of counters (a power of two: one for each KB of input).
SKETCH = 1 << 21, 1 << 24
CHUNKS = 32
PARITY = 4  # 64-bit words of a parity bitmap


def sketch_size(docs: DataFrame) -> int:
    """Counters for this input, by the planner's estimate of its bytes."""
    return power_of_two(SKETCH[0], float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1024, SKETCH[1])


def _counter(values: np.ndarray, size: int) -> np.ndarray:
    return (values >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw, off = text_buffer(texts)
    words, rows, _ = word_hashes(LOWER[raw], off)
    return distinct_by_row(*shingles(words, rows, width))


def _class_keys(values: np.ndarray, rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)))
        out.append(mix(sums[rows[1:]] - sums[rows[:-1]] + np.diff(rows).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def least_overlap(s: int, t: int, share: tuple[int, int]) -> int:
    """Fewest common shingles of linked sets of sizes s and t."""
    num, den = share
    return -(-num * (s + t) // (num + den))


def _sizes(n: int, share: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest size of a partner."""
    num, den = share
    return -(-num * n // den), den * n // num


def subsets_of(n: int, most: int, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(s, t, c) of the groups that a small set of size n enters, with partners up to size most."""
    lo, hi = _sizes(n, share)
    pairs = [(n, t) for t in range(n, min(hi, most) + 1)] + [(s, n) for s in range(lo, n)]
    found = ((s, t, least_overlap(s, t, share)) for s, t in pairs)
    return [(s, t, c) for s, t, c in found if c <= s and not s == t == c]


def subsets_each(n: int, share: tuple[int, int]) -> int:
    """How many subsets a set of size n enumerates if no set is larger."""
    return sum(math.comb(n, c) for _, _, c in subsets_of(n, n, share))


def list_cost(n: int, share: tuple[int, int], list_length: float) -> float:
    num, den = share
    return (n - -(-num * n // den) + 1) * (1 + list_length)


def largest_light(longest: int, share: tuple[int, int], list_length: float) -> int:
    """The size beyond which subsets of a set never cost less than its lists, up to the longest that occurs."""
    n = 0
    while n < longest and math.comb(n + 1, least_overlap(n + 1, n + 1, share)) <= (n + 2) * (1 + list_length):
        n += 1
    return n


def boundary(counts: dict[int, int], share: tuple[int, int], list_length: float) -> int:
    """The size up to which subsets cost less than lists, over the sizes that occur."""
    best, best_cost, cost = 0, 0.0, 0.0
    for n in range(1, max(counts, default=0) + 1):
        if n in counts:
            cost += counts[n] * (subsets_each(n, share) - list_cost(n, share, list_length))
        if cost <= best_cost:
            best, best_cost = n, cost
    return best


def profile(docs: DataFrame, width: int, seed: int, id_col: str, text_col: str, size: int = SKETCH[0]) -> DataFrame:
    """One pass: rows of (id, n, cls, cls2), and the task's shingle counters in CHUNKS rows, a byte each or four."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        names = ["id", "n", "cls", "cls2", "chunk", "counts"]
        for b in batches:
            values, rows = _sets(b["t"], width)
            at, times = np.unique(_counter(values, size), return_counts=True)
            counts[at] += np.minimum(times, np.uint32(0xFFFFFFFF) - counts[at]).astype(np.uint32)
            one, two = _class_keys(values, rows, seed)
            n = np.diff(rows)
            none = n == 0
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(n), pa.array(one, mask=none), pa.array(two, mask=none), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        part = counts.astype("<u4" if counts.max() > 255 else "u1").reshape(CHUNKS, -1)
        null = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([x.tobytes() for x in part], pa.binary())], names=names)

    got = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return written(got.mapInArrow(run, "id long, n long, cls long, cls2 long, chunk int, counts binary"), "profile")


def rarity(profiled: DataFrame, size: int = SKETCH[0]) -> np.ndarray:
    """Per counter, 4 log2(1 + count) rounded, over all documents: a byte each."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(x, "<u4" if len(x) > size // CHUNKS else "u1").astype(np.int64)
        packed = [np.minimum(np.rint(4 * np.log2(1 + x)), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    got = profiled.filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros((CHUNKS, size // CHUNKS), np.uint8)
    for r in got:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def keys(docs: DataFrame, width: int, seed: int, share: tuple[int, int], most: int, ranks, id_col: str, text_col: str) -> DataFrame:
    """Per class and task: the subset keys of small sets (kind 0), the rarest shingles of large ones (kind 1), the
    parity bitmap (kind 2)."""
    num, den = share
    low = _sizes(most + 1, share)[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = ranks.value, set()
        for b in batches:
            values, rows = _sets(b["t"], width)
            cls, _ = _class_keys(values, rows, seed)
            order = (rank[_counter(values, len(rank))].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
            out: list[tuple[int, int, int, int, list]] = []
            for r, (lo, hi) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                n, c = hi - lo, int(cls[r])
                if not n or c in seen:
                    continue
                seen.add(c)
                odd = np.bincount((values[lo:hi] & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                out.append((2, c, n, 0, np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
                if n <= most:
                    grouped: dict[int, list[np.ndarray]] = {}
                    own = mix(values[lo:hi])
                    total = own.sum(dtype=np.uint64)
                    for s, t, least in subsets_of(n, most, share):
                        gone = np.array([own[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), n - least)], np.uint64)
                        grouped.setdefault(s, []).append(mix(total - gone + np.uint64((s << 32) + t)).view(np.int64))
                    out += [(0, c, n, s, np.concatenate(x).tolist()) for s, x in grouped.items()]
                if n >= low:
                    first = np.partition(order[lo:hi], (n - -(-num * n // den)))[: n - -(-num * n // den) + 1]
                    first.sort()
                    out.append((1, c, n, 0, first.view(np.int64).tolist()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["kind", "cls", "n", "s", "keys"])

    got = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return written(got.mapInArrow(run, "kind int, cls long, n long, s int, keys array<long>"), "keys")


def lists(keyed: DataFrame) -> DataFrame:
    """Entries (key, cls, n, pos) of inverted lists with two entries or more."""
    large = keyed.filter("kind = 1")
    shared = written(large.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1").select("key"), "shared")
    held = bit_table(shared, F.xxhash64("key"))

    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(in_table(held, b["h"].to_numpy()))

    rows = large.select("cls", "n", F.posexplode("keys").alias("pos", "key")).withColumn("h", F.xxhash64("key"))
    rows = rows.mapInArrow(screen, rows.schema).drop("h")  # what is surely in one list alone goes before the shuffle
    # entries of one class from several tasks are folded before they are dealt by key alone: an aggregate in the join's
    # stage would keep adaptive execution from splitting a hot key
    once = written(rows.groupBy("key", "cls").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "entries")
    return written(once.join(shared, "key", "left_semi").select("key", "cls", "n", "pos"), "lists")


def _fits(a: str, b: str, share: tuple[int, int], most: int) -> str:
    """SQL test of two list entries by size, boundary and position."""
    num, den = share
    need = f"({num} * ({a}.n + {b}.n) + {num + den - 1}) div {num + den}"
    return (
        f"greatest({a}.n, {b}.n) > {most} and {den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n)"
        f" and least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}"
    )


def _small_pairs(keyed: DataFrame) -> DataFrame:
    entries = keyed.filter("kind = 0").select("cls", "n", "s", F.explode("keys").alias("key"))
    heads = written(entries.filter("n = s").groupBy("key").agg(F.min("cls").alias("head")), "heads")
    return entries.join(heads, "key").filter("cls <> head").select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b"))


def _first_pairs(entries: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    head = entries.groupBy("key").agg(F.min(F.struct("pos", "n", "cls")).alias("h"))
    head = written(head.select("key", F.col("h.pos").alias("pos"), F.col("h.n").alias("n"), F.col("h.cls").alias("cls")), "heads")
    got = entries.alias("x").join(head.alias("y"), (F.col("x.key") == F.col("y.key")) & F.expr(f"x.cls <> y.cls and {_fits('x', 'y', share, most)}"))
    return got.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def _rest_pairs(entries: DataFrame, labels: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    """Pairs of entries of one list from different components."""
    marked = entries.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", "pos", F.coalesce("comp", "cls").alias("comp"))
    marked = written(marked, "marked")
    open_ = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    open_ = written(open_, "open-keys")
    marked = written(marked.join(open_, "key", "left_semi"), "open")
    x, y = marked.alias("x"), marked.alias("y")
    got = x.join(y, (F.col("x.key") == F.col("y.key")) & F.expr(f"x.cls < y.cls and x.comp <> y.comp and {_fits('x', 'y', share, most)}"))
    return got.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def _near(pairs: DataFrame, marks: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs that their parity bitmaps do not rule out. marks: one row a class, written, so that a class in very many
    pairs can be split."""
    num, den = share
    x = marks.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    y = marks.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    apart = " + ".join(f"bit_count(ka[{i}] ^ kb[{i}])" for i in range(PARITY))
    most = f"na + nb - 2 * (({num} * (na + nb) + {num + den - 1}) div {num + den})"
    return pairs.join(x, "a").join(y, "b").filter(f"{apart} <= {most}").select("a", "b")


def _texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, t): one text of each wanted class; nothing is shuffled. A text is smaller than its set of hashes."""
    reps = written(classes.join(wanted, "cls", "left_semi").select("cls", "rep"), "wanted")
    by_id, by_class = bit_table(reps, F.xxhash64("rep")), bit_table(reps, F.col("cls"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            b = b.filter(in_table(by_id, b["h"].to_numpy()))
            cls, _ = _class_keys(*_sets(b["t"], width), seed)
            first = pa.array([not (c in done or done.add(c)) for c in cls.tolist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(cls), b["t"]], names=["cls", "t"]).filter(pc.and_(first, in_table(by_class, cls)))

    got = docs.select(F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).alias("t"))
    return got.mapInArrow(run, "cls long, t string")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Pairs whose whole sets meet the similarity."""
    num, den = share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, p), (y, q) = _sets(b["ta"], width), _sets(b["tb"], width)
            ok = np.zeros(b.num_rows, bool)
            for r in range(b.num_rows):
                u, v = x[p[r] : p[r + 1]], y[q[r] : q[r + 1]]
                shared = len(np.intersect1d(u, v, assume_unique=True))
                ok[r] = den * shared >= num * (len(u) + len(v) - shared)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    x, y = (texts.select(F.col("cls").alias(k), F.col("t").alias(f"t{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def join_components(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links of Jaccard >= share)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = sketch_size(docs)
    for seed in range(8):
        profiled = profile(docs, width, seed, id_col, text_col, size)
        rows = profiled.filter("chunk is null").select("id", "n", "cls", "cls2")
        grouped = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("cls2").alias("lo"), F.max("cls2").alias("hi"))
        classes = written(grouped, "classes")
        if classes.filter("lo <> hi").isEmpty():  # else two different sets share a 64-bit key: hash anew
            break
    ranks = rarity(profiled, size)
    used = ranks[ranks > 0]
    list_length = float(np.exp2(used.astype(float).mean() / 4)) if len(used) else 1.0
    longest = classes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    light = classes.filter(F.col("n") <= largest_light(longest, share, list_length))
    most = boundary({r["n"]: r["count"] for r in light.groupBy("n").count().collect()}, share, list_length)
    keyed = keys(docs, width, seed, share, most, spark.sparkContext.broadcast(ranks), id_col, text_col)
    entries = lists(keyed)
    marks = written(keyed.filter("kind = 2").select("cls", "n", "keys").dropDuplicates(["cls"]), "marks")

    # a class has one representative row unless ids repeat; only then must its text be made single again
    once = rows.groupBy("id").count().filter("count > 1").isEmpty()
    single = (lambda x: x) if once else (lambda x: x.dropDuplicates(["cls"]))

    pairs = written(_near(_small_pairs(keyed).unionByName(_first_pairs(entries, share, most)).distinct(), marks, share), "pairs")
    texts = written(single(_texts_of(docs, classes, _nodes(pairs), width, seed, id_col, text_col)), "texts")
    edges = written(_verified(pairs, texts, width, share), "links")
    labels = components(edges)

    rest = written(_near(_rest_pairs(entries, labels, share, most).distinct().join(pairs, ["a", "b"], "left_anti"), marks, share), "pairs")
    if not rest.isEmpty():
        texts = written(single(_texts_of(docs, classes, _nodes(rest), width, seed, id_col, text_col)), "texts")
        found = written(_verified(rest, texts, width, share), "links")
        if not found.isEmpty():
            labels = components(edges.unionByName(found))

    named = classes.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    named = written(named, "named")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = written(named.join(least, "comp").select("cls", "component_id"), "components")
    return rows.join(final, "cls", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those linked, directly or over others, to a document of smaller id; all columns kept.

    Rows without an id can't be told apart and stay."""
    found = join_components(docs, width, share, id_col, text_col)
    mark = free_name(docs, "__lost")
    lost = written(found.filter("component_id < doc_id").select(F.col("doc_id").alias(mark)).distinct(), "lost")
    return docs.join(lost, F.col(id_col).cast("long") == F.col(mark), "left_anti")
