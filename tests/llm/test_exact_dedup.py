import hashlib
import os
import random
import tracemalloc

from attestry.llm import exact_dedup as X

ROWS = [(1, "Same Text", "x"), (5, "same text", "y"), (3, "SAME TEXT", None), (2, None, "z"), (4, "", "z"), (6, "É", "q"), (7, "é", "q"), (8, "long " * 50_000, "l"), (8, "long " * 50_000, "l"), (None, "only", None), (9, "only", None)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")  # a column that clashes with the index's


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def test_decisions(spark):
    got = X.decide(frame(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].keep_id for i in (1, 3, 5)] == [5, 5, 5] and by[5][0].kept and not by[1][0].kept and by[1][0].group_size == 3
    assert by[2][0].keep_id == 4 and by[4][0].kept and by[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6][0].kept and by[7][0].kept  # only A-Z is lower-cased
    assert sorted(r.kept for r in by[8]) == [False, True]
    assert by[None][0].keep_id == 9 and not by[None][0].kept
    assert by[5][0].text_sha256 == hashlib.sha256(lower("Same Text").encode()).hexdigest()


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    got = X.deduplicate(frame(spark))
    assert got.columns == ["doc_id", "text", "digest"]
    assert sorted((r.doc_id, r.digest) for r in got.collect()) == [(4, "z"), (5, "y"), (6, "q"), (7, "q"), (8, "l"), (9, None)]


def test_empty(spark):
    assert X.decide(frame(spark, [])).count() == 0 and X.deduplicate(frame(spark, [])).count() == 0


def test_filter_inserts_deletes_and_resizes():
    random.seed(1)
    keys = [os.urandom(32) for _ in range(5000)]
    live = X.LiveDigests(buckets=4)
    for k in keys:
        live.insert(k, (True, 1, 0), 1, 1)
    assert live.resizes > 0 and all(k in live.filter for k in keys)
    for k in keys[:2500]:
        assert live.delete(k) and not live.delete(k)
    assert all(k in live.filter for k in keys[2500:])
    assert sum(k in live.filter for k in keys[:2500]) < 100
    assert len(list(live.entries())) == 2500


def test_a_false_hit_is_told_apart_by_its_content():
    live = X.LiveDigests()
    a = b"\x01" * 31 + b"a"
    b = b"\x01" * 31 + b"b"  # same fingerprint, same bucket
    live.insert(a, (True, 1, 0), 1, 1)
    assert b in live.filter
    live.insert(b, (True, 2, 0), 1, 1)
    assert len(list(live.entries())) == 2


def test_index_updates(spark):
    index = X.build_index(X.digests(frame(spark)))
    gone = index.filter("keep_id = 5").select("digest")
    more = X.digests(frame(spark, [(11, "é", None), (12, "new", None)]))
    after = {r.keep_id: r.group_size for r in X.update_index(index, more, gone).collect()}
    assert 5 not in after and after[11] == 2 and after[12] == 1 and after[4] == 2


def test_lookups_read_content_only_on_fingerprint_hits():
    random.seed(2)
    live = X.LiveDigests()
    keys = [random.randbytes(32) for _ in range(20_000)]
    for k in keys:
        live.insert(k, (True, 1, 0), 1, 1)
    assert live.verified < 40  # new keys are told new by the filter alone
    seen = live.verified
    for k in keys[:1000]:
        live.insert(k, (True, 1, 0), 1, 1)
    assert 1000 <= live.verified - seen < 1040
    gone = set()
    for _ in range(5000):  # any order of operations, against a set
        k = keys[random.randrange(300)]
        if random.random() < 0.5:
            assert live.delete(k) == (k not in gone)
            gone.add(k)
        else:
            live.insert(k, (True, 2, 0), 1, 1)
            gone.discard(k)
    assert len(live) == 20_000 - len(gone) and {e[0] for e in live.entries()} == set(keys) - gone


def test_memory_of_the_index_is_bounded_by_its_part(spark, monkeypatch):
    live = X.LiveDigests()
    tracemalloc.start()
    for i in range(50_000):
        live.insert(hashlib.sha256(str(i).encode()).digest(), (True, i, i), 1, 1)
    assert tracemalloc.get_traced_memory()[0] < 150 * 50_000
    tracemalloc.stop()
    monkeypatch.setattr(X, "PART_ENTRIES", 500)
    monkeypatch.setattr(X, "FOLD_ENTRIES", 64)
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2500 as string) as text").coalesce(1)
    dealt = []
    plain = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda df, n, *c: dealt.append(n) or plain(df, n, *c))
    got = X.decide(rows).groupBy("group_size", "kept").count().collect()
    assert dealt == [10] and {(r.group_size, r.kept): r["count"] for r in got} == {(2, True): 2500, (2, False): 2500}


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "A", 4, 5, 6), (2, "A", 4, 5, 6)], "doc_id long, text string, __digestk int, __DIGEST int, __digest_i int")
    got = X.deduplicate(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(2, "A", 4, 5, 6)]
