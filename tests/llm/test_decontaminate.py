import random
import re

from attestry.llm import decontaminate as D


def brute(docs, items, threshold=0.8, width=5):
    def sh(t, k):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    out = []
    for i, t in items:
        n = sh(t, 1)[1]
        k = min(width, n)
        own = sh(t, k)[0] if n else set()
        for d, x in docs:
            if own and len(own & sh(x, k)[0]) >= threshold * len(own):
                out.append((d, i, len(own & sh(x, k)[0]), len(own)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 8, 20, 40, 80])))) for i in range(30)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.choice([0, 4, 60, 900]))]
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x[0].upper() + ",", *x[1:]]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (docs[0][0], docs[0][1])]
    items += [(77, ""), (78, None)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got) == want and len(want) > 50
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    kept = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {x[0] for x in want})


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.leaks(docs, items).count() == 0
    assert D.leaks(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items.filter("false")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, f"one{i} two{i} three{i} four{i} five{i} six{i}") for i in range(20)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_SHINGLES", 40)
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()) == [(i, i) for i in range(20)]


def test_every_occurrence_of_a_short_item_is_found(spark):
    items = D.Items([1], ["alpha beta"], 5)
    texts = [f"n{i} alpha beta m{i}" for i in range(8000)]
    raw, off = D.text_buffer(D.pa.array(texts))
    assert len({r for r, *_ in D.matches(items, raw, off, 0.8)}) == len(texts)


def test_items_without_id_are_heeded(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three four five six")], "item_id long, text string")
    assert [r.doc_id for r in D.decontaminate(docs, items).collect()] == [2] and D.leaks(docs, items).count() == 0


def test_many_items_with_shared_wording_in_many_blocks(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    lead = "answer the following question with one of"
    items = [(i, f"{lead} {' '.join(rng.choices(words, k=rng.randrange(0, 30)))}") for i in range(60)]
    docs = [(i, " ".join([*rng.choices(words, k=40), rng.choice(items)[1] if i % 3 else lead, *rng.choices(words, k=9)])) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def sets(t, k=5):
        w = t.split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = sorted((x, y, len(sets(s) & sets(t))) for x, s in docs for y, t in items if len(sets(s) & sets(t)) >= 0.8 * len(sets(t)))
    for size in (D.BLOCK_SHINGLES, 300):
        monkeypatch.setattr(D, "BLOCK_SHINGLES", size)
        assert sorted((r.doc_id, r.item_id, r.n_shared) for r in D.leaks(d, b).collect()) == want and len(want) > 20
        assert sorted(r.doc_id for r in D.decontaminate(d, b).collect()) == sorted({x for x, _ in docs} - {x for x, _, _ in want})
