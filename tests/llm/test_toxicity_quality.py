import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import hashing
from attestry.llm import quality as Q
from attestry.llm import toxicity as T
from attestry.llm.common import text_buffer

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    plain = "the house stood near a quiet river and people walked along its banks in summer with their dogs".split()
    bad = ["idiot", "moron", "worthless", "zumpak"]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                x = rng.choice(bad)
                w.insert(rng.randrange(len(w)), x + rng.choice(["", "en", "isch"]) if x == "zumpak" else x)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    return T.fit(*corpus)


@pytest.mark.parametrize("text", ["what an 1d10t", "you i d i o t there", "idiiiiiot", "m0r0n!", "(w0rthle55)", "zumpakerei", "I.D.I.O.T", "mo-ron", "IDIOT"])
def test_disguised_words_are_restored(model, text):
    assert T.scores(pa.array([text]), model)[0] >= 0.7, list(T.suspects(*T.text_buffer(pa.array([text.lower()]))))


COMBINED = {
    "leet repeated": "m000r0n", "leet repeated at the end": "idi0000t", "letter twice": "idiiot", "doubled everywhere": "iiddiioott", "gap run": "i--d--i--o--t", "dots": "i...d...i...o...t",
    "leet and gap": "1.d.1.0.t", "leet and gap run": "1--d--1--0--t", "leet, gap and repeat": "11-dd-11-00-tt", "other sign": "i#d#i#o#t", "middle dot": "i·d·i·o·t", "mixed gaps": "i-.d_*i~'o-t",
    "wide spaces": "i   d   i   o   t", "spaces and dots": "i. d. i. o. t.", "spaced signs": "i - d - i - o - t", "spaced leet": "1 d 1 0 t", "euro": "w0rthl€ss", "repeat and leet": "mooor000n",
}


@pytest.mark.parametrize("text", COMBINED.values(), ids=COMBINED)
def test_combined_disguises_are_restored(model, text):
    assert T.scores(pa.array([f"the river {text} near"]), model)[0] >= 0.7, list(T.suspects(*T.text_buffer(pa.array([text]))))


def test_spaced_letters_are_code_points():
    texts = ["d é b i l e", "der debilé é é d", "ab", "bc"]
    got = list(T.suspects(*T.text_buffer(pa.array(texts))))
    assert (0, "d é b i l e") in got and (1, "é é d") in got and not [r for r, _ in got if r > 1]
    assert T.restore("a" * 3 + "b-c" * 50_000, np.zeros((T.SIZE**2, T.SIZE), np.float32))


@pytest.mark.parametrize("text", ["the quiet river", "", None, "*** ### $$$ %%%", "walked in 1999 near 10 Downing", "a.b@mail8.example.com 4317133518190532", "x" * 200_000, "the " * 100_000])
def test_clean_texts_stay_clean(model, text):
    assert T.scores(pa.array([text], pa.string()), model)[0] < 0.3


def test_toxicity_of_a_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    got = T.score(docs, model).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 1").toPandas()
    assert ((got.score >= 0.7) == (got.toxic == 1)).mean() > 0.93 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) & (got.toxic == 0)).sum() <= 2


def test_edges_and_reject(spark, corpus, model):
    odd = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "you idiot moron", "p"), (3, "you idiot moron", "p"), (None, "a quiet house", "p")], "doc_id long, text string, score string")
    assert T.score(odd, model).count() == 5
    kept = T.reject(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    assert T.reject(odd.filter("false"), model).count() == 0
    none = T.fit(corpus[0], corpus[1].filter("false"))
    assert {r.score for r in T.score(odd, none).collect()} == {0.0}


def test_language_model_counts_all_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abc abc", "abd", None, "", "ABC"])], "doc_id long, text string").repartition(3)
    logp = np.exp(T.language_model(docs))
    a, b, c, d = (int(T.CLASS[ord(x)]) for x in "abcd")
    row = logp[a * T.SIZE + b]
    assert abs(row.sum() - 1) < 1e-4 and row[c] > 2 * row[d] > 0


def test_quality_of_a_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    net = Q.fit(docs, labels.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = Q.score(docs, net).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.93 and 0.1 < net.temperature < 6
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "word", 0), (4, "word", 0), (5, "many words " * 80_000, 0)], "doc_id long, text string, score int")
    rows = Q.score(odd, net).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert Q.score(odd.filter("false"), net).count() == 0
    flat = Q.fit(docs, labels.filter(F.col("quality") == 1))
    assert {r.score for r in Q.score(odd, flat).collect()} == {1.0}


def test_index_vectors_come_from_neighbours(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "alpha beta gamma")], "doc_id long, text string")
    word, shape, n, rows = Q._tokens(pa.array(["alpha beta gamma"]))
    table = Q.vectors(docs)
    want = np.zeros(Q.WIDTH)
    for step, source in ((0, shape), (-1, shape), (1, shape), (-1, word), (1, word)):
        near = source[1 + step] + (Q.BUCKETS if source is shape else 0)
        np.add.at(want, Q._AT[near], Q._SIGN[near])
    assert np.allclose(table[word[1]], want) and list(n) == [5, 4, 5] and list(np.diff(rows)) == [3]


def test_word_vectors_and_pooling_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "GAMMA", "x1!!", "d"]) for _ in range(rng.randrange(0, 12))) for _ in range(25)] + [None, ""]
    sums, counts = np.zeros((Q.BUCKETS, Q.WIDTH)), np.zeros(Q.BUCKETS)
    index = lambda i: sum(np.eye(Q.WIDTH)[Q._AT[i, k]] * Q._SIGN[i, k] for k in range(2))
    for t in texts:
        word, shape, _, _ = Q._tokens(pa.array([t], pa.string()))
        for i, w in enumerate(word):
            counts[w] += 1
            sums[w] += index(Q.BUCKETS + shape[i])
            for j in (i - 1, i + 1):
                if 0 <= j < len(word):
                    sums[w] += index(Q.BUCKETS + shape[j]) + index(word[j])
    got = Q.vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = sums / np.maximum(counts[:, None], 1)
    assert np.allclose(got, want, atol=1e-6)
    pooled = Q.pooled(pa.array(texts, pa.string()), got)
    for t, row in zip(texts, pooled, strict=True):
        word, _, n, _ = Q._tokens(pa.array([t], pa.string()))
        v = want[word]
        assert np.allclose(row[: Q.WIDTH], v.mean(0) if len(v) else 0, atol=1e-4) and np.allclose(row[Q.WIDTH : 2 * Q.WIDTH], v.std(0) if len(v) else 0, atol=2e-3)
        if len(v):
            assert np.isclose(row[2 * Q.WIDTH], np.log1p(len(v)), atol=1e-5) and np.isclose(row[2 * Q.WIDTH + 3], n.mean() / 10, atol=1e-5)


def test_network_equals_its_formula():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(Q.BUCKETS, Q.WIDTH)).astype(np.float32)
    d = 2 * Q.WIDTH + 5
    net = Q.Network(table, rng.normal(size=d), rng.uniform(1, 2, d), [rng.normal(size=(d, 3)), rng.normal(size=3), rng.normal(size=(3, 1)), rng.normal(size=1)], temperature=1.7)
    texts = pa.array(["one two Two", "", None, "a " * 500])
    for x, s in zip(Q.pooled(texts, table), net.scores(texts), strict=True):
        hidden = [math.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.weights[0][i, k] for i in range(d)) + net.weights[1][k]) for k in range(3)]
        logit = (sum(h * net.weights[2][k, 0] for k, h in enumerate(hidden)) + net.weights[3][0]) / net.temperature
        assert abs(1 / (1 + math.exp(-logit)) - s) < 1e-6


def test_scores_of_toxicity_equal_brute_force(spark):
    """Each distinct lexicon word, as written or restored by a Viterbi search over all readings, weighs once."""
    texts = ["you idiot", "an 1d1ot here", "nice day", "idiot idiot", "", None, "i d i o t", "nice idiots"]
    words = [hashing.word_hashes(*text_buffer(pa.array([w])), T.BREAK)[0][0] for w in ("idiot", "nice")]
    order = np.argsort(words)
    model = T.Model(T.language_model(spark.createDataFrame([("you idiot nice day here idiot",)] * 50, "text string"), "text"))
    model.base = 0.1
    model.entries = {0: (np.array(words)[order], np.array([-2.0, -0.5])[order])}
    got = T.scores(pa.array(texts, pa.string()), model)
    for text, score in zip(texts, got, strict=True):
        raw, off = text_buffer(pa.array([(text or "").lower()]))
        seen = set(re.findall(r"\w+", (text or "").lower()))
        for _, token in T.suspects(raw, off):
            seen |= {w for r in T.restore(token.strip(), model.logp) for w in re.findall(r"\w+", r)}
        total = -2.0 * ("idiot" in seen) - 0.5 * ("nice" in seen)
        assert abs(score - (1 - 0.9 * math.exp(total) if total else 0.1)) < 1e-9, text
    assert got[1] == got[0] == got[3] and got[4] == got[5] == 0.1


def test_scores_do_not_hang_on_blocks(model, monkeypatch):
    texts = pa.array(["", None, "the river", "you 1d10t " * 3, "", "plain words near", "i d i o t", "x" * 400, None])
    whole = T.scores(texts, model)
    for size in (1, 8, 40):
        monkeypatch.setattr(T, "BLOCK", size)
        assert T.scores(texts, model).tolist() == whole.tolist()
        assert T.scores(texts.slice(3, 4), model).tolist() == whole[3:7].tolist()
