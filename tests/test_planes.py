import pytest
from pyspark.sql import functions as F

from attestry.functions import values as V
from attestry.operators import graph, planes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_values(spark):
    df = spark.createDataFrame([("ab-12", "ff", "  x y \n", [7, 8], None), ("none", "fg", "", [], 3.0)], "a string, b string, c string, l array<int>, s double")
    cases = [(r"([a-z]+)-(\d+)", r"\2/\1"), (r"no.*", "NO")]
    got = df.select(V.templated("a", cases), V.radix("b", 16), V.trimmed("c"), V.item("l", F.lit(1), 1), V.item("l", F.lit(5)), V.span("a", F.lit(1), F.lit(3)), V.span("a", F.lit(1), F.lit(3), True), V.score(F.col("s"), 1, 5))
    assert {tuple(r) for r in got.collect()} == {("12/ab", 255, "x y", 7, None, "b-", "b-1", 1.0), ("NO", None, "", None, None, "on", "one", 0.5)}
    assert df.select(V.templated("b", cases)).first()[0] is None


def test_role_pull_rises_with_salience_and_unknown_words_pull_least(spark):
    words = spark.createDataFrame([(1, "the"), (1, "cat"), (1, "zzz"), (1, "cat")], "prompt int, word string")
    said = spark.createDataFrame([("the", 0.5), ("cat", 4.0)], "word string, info_bits double")
    assert {r.word: round(r.pull, 4) for r in planes.role_pull(words, said).collect()} == {"the": 0.15, "cat": 1.0, "zzz": 0.1}


def test_support_bits_use_every_lane_and_refuse_what_they_cannot_tell(spark):
    edges = spark.createDataFrame([("a", "n"), ("b", "n"), ("b", "m")], "a string, b string")
    prompts = spark.createDataFrame([(1, 3, "a"), (1, 130, "b")], "prompt int, ordinal int, word string")
    assert rows(planes.support_bits(prompts, edges)) == [(1, "m", 0, 0, 4, 0), (1, "n", 8, 0, 4, 0)]
    with pytest.raises(Exception, match="too many words"):
        planes.support_bits(spark.createDataFrame([(1, 256, "a")], "prompt int, ordinal int, word string"), edges).collect()


def test_sense_priors_fall_back_on_rank(spark):
    lex = spark.createDataFrame([("w", "a", 3, 1), ("w", "b", 0, 2), ("v", "a", 0, 1), ("v", "b", 0, 2)], "lemma string, concept string, uses long, rank int")
    got = {(r.lemma, r.concept): round(r.prior, 4) for r in planes.sense_priors(lex).collect()}
    assert got == {("w", "a"): -0.2231, ("w", "b"): -1.6094, ("v", "a"): 0.0, ("v", "b"): -0.6931}


def test_loss_contrast_without_any_outcome(spark):
    words = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (2, "y")], "parent int, word string")
    outcomes = spark.createDataFrame([(1, True), (2, False)], "parent int, won boolean")
    assert rows(planes.loss_contrast(words, outcomes)) == [("x", 1, 1, 0.0), ("y", 1, 0, 1.0)]
    assert planes.loss_contrast(words, outcomes.filter("false")).count() == 0


def test_take_segment_stops_where_more_end_or_none_agree(spark):
    paths = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "c"]), (4, ["d"]), (5, ["d"]), (6, ["d"]), (7, ["d", "e"]), (8, ["d", "e"]), (9, ["f", "g"])], "parent int, path array<string>")
    asked = spark.createDataFrame([("a",), ("d",), ("f",)], "segment string")
    assert rows(planes.take_segment(paths, asked, 1)) == [("a", "b", 2, 3, 0)]


def test_upward_reads_only_hubs(spark):
    claims = spark.createDataFrame([(f"c{i}", [f"x{i}", "in", "hub"]) for i in range(5)] + [("up", ["hub", "part of", "top"])], "claim string, parts array<string>")
    assert rows(planes.upward(claims, ["part of"], 3)) == [("hub", "part of", "up")]


def test_order_records_turns_and_draws(spark):
    asked = spark.createDataFrame([(1, ["b", "z", "b"])], "set_id int, keys array<string>")
    known = spark.createDataFrame([("b", 2)], "k string, n int")
    assert {tuple(r) for r in planes.in_order(asked, known, "k").collect()} == {(1, 0, "b", 2), (1, 1, "z", None), (1, 2, "b", 2)}
    claims = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (2, 1, "x")], "r int, position int, claim string")
    assert rows(planes.records(claims, "r", ["position"], lambda c: F.array_join(c, "+"))) == [(1, 2, "x+y"), (2, 1, "x")]
    turns = spark.createDataFrame([("s", 1, "p"), ("s", 2, "q"), ("s", 3, "p"), ("s", 4, "r")], "s string, t int, claim string")
    assert sorted((r.claim, r.place) for r in planes.said_once(turns, "s", ["t"]).collect()) == [("p", 1), ("q", 2), ("r", 3)]
    near = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 0.9), ("k", "c", 0.1)], "k string, n string, v double")
    first = graph.draw_within(near, "k", "n", "v", 0.2, "s").collect()
    assert first == graph.draw_within(near.repartition(3), "k", "n", "v", 0.2, "s").collect() and first[0].n in "ab"
