import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestry.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "Hello world, it's 42 degrees.", "a"), (2, None, "b"), (3, "", "c"), (4, "tok " * 5000, "d"), (5, "a <|endoftext|> b", "e"), (6, "É世界 \n\n  x", "f"), (1, "Hello world, it's 42 degrees.", "a")]


def test_pieces_and_places(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, piece string")
    got = P.pack_documents(df, PATH, 512, 0, with_ids=True).toPandas()
    tok = Tokenizer.from_file(PATH)
    for doc, text, _ in ROWS:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc].drop_duplicates("piece").sort_values("piece")
        assert [x for part in own.ids for x in part] == ids
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 512).all() and list(own.start) == list(own.length.cumsum() - own.length)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len(got[got.doc_id == 1]) == 2
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 512 and list(s.offset) == list(s.length.cumsum() - s.length)


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    rng = np.random.default_rng(2)
    length = rng.integers(1, 400, 800)
    costs = np.stack((length, np.ones(800), length**2), 1).astype(float)
    capacity = np.array([1000.0, 6.0, 400_000.0])
    bins = P.best_fit(costs, capacity, rule)
    for b in np.unique(bins):
        assert (costs[bins == b].sum(0) <= capacity).all()
    lower = max((costs.sum(0) / capacity).max(), 1)
    assert len(np.unique(bins)) <= 1.15 * lower + 1


def test_best_fit_is_near_the_bound_with_tokens_alone():
    length = np.random.default_rng(3).integers(1, 2048, 4000)
    costs = np.stack((length, np.ones(4000), length.astype(float) ** 2), 1)
    bins = P.best_fit(costs, np.array([2048.0, 2048, 2048**2]), "norm", np.array([1, 1e-6, 1e-6]))
    assert len(np.unique(bins)) <= 1.02 * -(-length.sum() // 2048) + 2


def test_windows_bound_memory_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOW", 16)
    rows = [(7, "same words again", "x")] * 100
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, s string"), PATH, 64).toPandas()
    assert len(got) == 100 and (got.groupby("sequence_id").length.sum() <= 64).all()


def naive(costs, capacity, rule, w):
    """Vector best-fit by the book: every open bin is tried for every piece."""
    bins, where = [], {}
    for i in sorted(range(len(costs)), key=lambda i: (-max(c / k * x for c, k, x in zip(costs[i], capacity, w)), i)):
        c = costs[i]
        best = None
        for b, room in enumerate(bins):
            if any(r < x for r, x in zip(room, c)):
                continue
            if rule == "norm":
                value = sum(x * ((r - y) / k) ** 2 for x, r, y, k in zip(w, room, c, capacity))
            else:
                value = -sum(x * r / k * y / k for x, r, y, k in zip(w, room, c, capacity))
            if best is None or value < best[0] - 1e-12:
                best = value, b
        if best is None:
            bins.append(list(capacity))
            best = 0, len(bins) - 1
        bins[best[1]] = [r - x for r, x in zip(bins[best[1]], c)]
        where[i] = best[1]
    return [where[i] for i in range(len(costs))], bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(1000.0, 300.0, 1e6), (1000.0, 3.0, 1e6), (1000.0, 300.0, 180_000.0), (1000.0, 4.0, 400_000.0)])
def test_best_fit_equals_brute_force_whatever_binds(rule, limits):
    length = np.random.default_rng(8).uniform(1, 400, 300)
    costs = np.stack((length, np.ones(300), length**2), 1)
    w = (1.0, 0.05, 0.05)
    want, rooms = naive(costs.tolist(), limits, rule, w)
    assert P.best_fit(costs, np.array(limits), rule, np.array(w)).tolist() == want
    binding = {(1000.0, 300.0, 1e6): 0, (1000.0, 3.0, 1e6): 1, (1000.0, 300.0, 180_000.0): 2}.get(limits)
    if binding is not None:  # that resource is the tightest in most bins
        assert sum(min(range(3), key=lambda k: r[k] / limits[k]) == binding for r in rooms) > len(rooms) / 2


def test_defaults_bind_and_stay_near_the_least(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(np.concatenate((rng.integers(1, 2049, 3000), rng.integers(1, 4, 3000))))]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")).toPandas()
    by = got.groupby("sequence_id").length
    assert len(got) == 6000 and by.sum().max() <= 2048 and by.count().max() <= 64
    shared = by.count() > 1
    assert (got.assign(a=got.length**2).groupby("sequence_id").a.sum()[shared] <= P.ATTENTION * 2048**2).all()
    assert by.ngroups <= 1.02 * -(-got.length.sum() // 2048)


def test_files_that_say_more_than_ranks_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert P.byte_bpe(path)("Two Words").tolist() == Tokenizer.from_file(path).encode("Two Words", add_special_tokens=False).ids
