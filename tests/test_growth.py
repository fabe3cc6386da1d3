"""What a query reads and moves must not grow faster than its input: scans and shuffles of plans, hot keys, bounded blocks."""

import re

import numpy as np
from pyspark.sql import functions as F

from attestry import queries as Q
from attestry import queries_forward  # noqa: F401
from attestry.operators import claims as C
from attestry.operators import containment as K
from attestry.operators import fold, phrases, shape

DATA = "/root/testdata/sf0.001"


def plan(df):
    """(scans of files, shuffles by a key) of a query's plan, before any of it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet", text)), len(re.findall(r"Exchange hashpartitioning", text))


def test_f1_a_part_that_every_claim_holds_is_cut_before_it_moves(spark):
    assert plan(Q.QUERIES["hop_entity"](spark, DATA)) == (1, 3)
    claims = spark.range(500).select(F.format_string("c%03d", "id").alias("claim"), F.array(F.lit("a"), F.lit("hot"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))).alias("parts"), (F.col("id") % 10 / 10).alias("conf"))
    each = {(r.src, r.claim) for r in C.claims_each(claims, None, "ends", fan=3, keep=[]).collect()}
    assert len(each) == 24 and {s for s, _ in each} == {"a", *(f"b{i}" for i in range(7))}
    asked = spark.createDataFrame([("x", "hot"), ("x", "a")], "src string, key string")
    got = C.claims_each(claims, asked, "any", None, 4).collect()  # the same claims under both keys, each key twice as often as it may give
    assert sorted((r.claim, r.conf) for r in got) == [("c009", 0.9), ("c009", 0.9), ("c019", 0.9), ("c019", 0.9)]


def test_f3_each_subjects_claims_come_from_one_read_and_two_shuffles(spark):
    assert plan(Q.QUERIES["hop_open_object"](spark, DATA)) == (1, 2)


def test_f5_positions_ride_with_the_standing(spark):
    assert plan(Q.QUERIES["positions_order"](spark, DATA)) == (1, 2)


def test_f8_uses_ride_with_the_standing(spark):
    assert plan(Q.QUERIES["usage_order"](spark, DATA)) == (1, 2)


def test_f10_the_best_of_a_part_is_found_where_its_claims_are(spark):
    assert plan(Q.QUERIES["top_within"](spark, DATA)) == (1, 2)


def test_f12_each_objects_claims_come_from_one_read(spark):
    assert plan(Q.QUERIES["hop_open_subject"](spark, DATA)) == (1, 3)


def test_f13_a_chain_moves_first_claims_only(spark):
    rows = spark.createDataFrame([("1", ["a", "r", "b"], 0.9, 2), ("2", ["a", "r", "c"], 0.9, 2), ("3", ["d", "r", "e"], 0.5, None)], "claim string, parts array<string>, conf double, position int")
    at = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "d"), ("z", "a")], "origin string, node string")
    step = C.follow(rows, at, "r")
    assert {r.origin: r.node for r in step.collect()} == {"x": "b", "y": "b", "z": "b"}
    text = step._jdf.queryExecution().optimizedPlan().toString()
    join = text.index("Join")
    assert "Window" in text[join:], "claims met the origins before they were cut"


def test_f17_leaves_never_meet_the_edges(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(K, "written", lambda df, label, real=K.written: labels.append(label) or real(df, label))
    edges = spark.createDataFrame([("x", "y", 1), ("x", "y", 1), ("y", "z", 3), ("x", "z", 1)], "child string, parent string, times long")
    got = K.multiplicity(edges, spark.createDataFrame([("z", 1)], "node string, occ long"))
    assert {r.node: r.occ for r in got.collect()} == {"z": 1, "y": 3, "x": 7}
    assert labels.count("edges") == 1 and labels.count("level") == 2  # no third level is looked for below x alone


def test_f18_tables_are_compared_in_one_pass(spark):
    reads, moves = plan(Q.QUERIES["replay_identical"](spark, DATA))
    assert reads == 3 and moves == 5
    a = spark.createDataFrame([("k", 1.0), ("l", 2.0), ("m", None), ("o", 4.0)], "claim string, v double")
    b = spark.createDataFrame([("k", 1.0), ("l", 2.5), ("m", None), ("n", 3.0)], "claim string, v double")
    for unique in (False, True):
        assert {r.claim for r in fold.differing(a, b, unique=unique).collect()} == {"l", "n", "o"}
    assert {r.claim for r in fold.differing(a.unionAll(a.limit(1)), a).collect()} == {"k"}


def test_f19_a_draw_reads_its_rows_once(spark):
    assert plan(Q.QUERIES["top_drawn"](spark, DATA)) == (1, 2)


def test_f11_nearest_holds_small_tiles_whatever_the_batch(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.integers(-3, 4, (150, 6)), np.tile(rng.integers(-3, 4, (1, 6)), (50, 1)))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(shape, "TILE_QUERIES", 7)
    monkeypatch.setattr(shape, "TILE_VECTORS", 11)
    got = {}
    for r in shape.nearest(df, df.filter("vec_id % 9 = 0"), 13).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.id
    for q in range(0, 200, 9):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        want = sorted((i for i in range(200) if i != q), key=lambda i: (d[i], i))[:13]
        assert [got[q][k + 1] for k in range(13)] == want


def _paths(spark):
    return spark.createDataFrame([(1, "a b c a b d".split()), (2, "b a c c".split()), (3, []), (4, ["a"]), (5, "x a b c".split())], "parent long, path array<string>")


def test_f2_contexts_are_not_shuffled_and_many_prompts_give_the_same(spark, monkeypatch):
    paths = _paths(spark)
    prompts = spark.createDataFrame([(1, "x a b".split()), (2, ["c"]), (3, ["zz"]), (4, "a b".split()), (5, [])], "parent long, path array<string>")
    got = phrases.follows_suffix(paths, prompts, 3)
    assert all("back" not in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)
    few = sorted(tuple(r) for r in got.collect())
    assert few == [(1, 3, "c", 1), (2, 1, "a", 1), (4, 2, "c", 2)]
    monkeypatch.setattr(phrases, "LAST_WORDS", 1)
    assert sorted(tuple(r) for r in phrases.follows_suffix(paths, prompts, 3).collect()) == few


def test_f4_votes_fold_where_the_texts_are_read(spark):
    assert plan(Q.QUERIES["voted_roles"](spark, DATA)) == (1, 2)


def test_f6_sets_are_tried_by_their_rarest_key(spark, monkeypatch):
    paths = _paths(spark)
    sets = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a"), (1, "c"), (1, "zz"), (2, "a"), (2, "c"), (3, "d")], "set_id int, key string")
    want = sorted(tuple(r) for r in K.holders_all(K.explode_paths(paths), sets).collect())
    for most in (100, 1):
        monkeypatch.setattr(K, "KEYS", most)
        assert sorted(tuple(r) for r in K.path_holders_all(paths, sets).collect()) == want == [(0, 1), (0, 2), (0, 5), (2, 1), (2, 2), (2, 5), (3, 1)]


def test_f7_hubs_are_left_out_where_they_are_read(spark):
    want, hubs = K.holders_capped(K.explode_paths(_paths(spark)), 2)
    got, mine = K.path_holders_capped(_paths(spark), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and sorted(map(tuple, mine.collect())) == sorted(map(tuple, hubs.collect()))
    assert plan(got)[1] == 0


def test_f9_seconds_are_looked_up_among_a_paths_own_words(spark, monkeypatch):
    paths = _paths(spark)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("a", "a"), ("c", "zz"), ("x", "c")], "a string, b string")
    want = sorted(map(tuple, K.holders_pair(K.explode_paths(paths), pairs).collect()))
    for most in (100, 1):
        monkeypatch.setattr(K, "KEYS", most)
        got = K.path_holders_pair(paths, pairs)
        assert sorted(map(tuple, got.collect())) == want
        assert most == 1 or all("parent" not in x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)


def test_f14_a_pair_is_counted_one_way_and_turned(spark):
    got = {(r.word, r.beside): r.paths for r in phrases.adjacent(spark.createDataFrame([(1, "a b a a".split()), (2, "b a".split()), (3, ["c"])], "parent long, path array<string>")).collect()}
    assert got == {("a", None): 2, ("b", None): 2, ("c", None): 1, ("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 1}
    text = phrases.adjacent(_paths(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "least(" in text[text.index("Aggregate") :]


def test_f15_lengths_look_where_shorter_ones_stand(spark, monkeypatch):
    paths = _paths(spark)
    prompts = spark.createDataFrame([(1, "a b c".split()), (2, "c c".split()), (3, [])], "parent long, path array<string>")
    got = phrases.segments_forward(paths, prompts, 3)
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    few = sorted(map(tuple, got.collect()))
    assert ("a b c", 3, "a", 1) in few and ("c c", 2, None, 1) not in few
    monkeypatch.setattr(phrases, "SEGMENTS", 1)
    assert sorted(map(tuple, phrases.segments_forward(paths, prompts, 3).collect())) == few


def test_f16_fills_fold_inside_their_rows(spark, monkeypatch):
    paths, occ = _paths(spark), spark.createDataFrame([(1, 10), (2, 100), (5, 1000)], "parent long, occ long")
    wanted = spark.createDataFrame([("a b",), ("b a",), ("a b",)], "segment string")
    assert plan(phrases.fills(paths.withColumn("occ", F.lit(1)), None, wanted, 2))[1] == 1
    for most in (100, 1):
        monkeypatch.setattr(phrases, "SEGMENTS", most)
        assert sorted(map(tuple, phrases.fills(paths, occ, wanted, 2).collect())) == [("a b", "c", 1010, 2), ("a b", "d", 10, 1), ("b a", "c", 100, 1)]
