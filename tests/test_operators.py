import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import core
from attestry.operators import claims as C
from attestry.operators import containment as K
from attestry.operators import coordinates, fold, graph, keys, phrases, shape, vocabulary
from attestry.plans import firmware, forward, recipe
from attestry.plans.tables import claim_table
from attestry.sources import readers, shapes
from attestry.streaming import ingest


def tallies(spark, rows):
    return spark.createDataFrame(rows, "claim string, witness string, lineage string, games long, tokens long, wins double, position int")


def test_glicko2_worked_example():
    r, d, v = fold.glicko2(1500, 200, 0.06, [(1400, 30, 1), (1550, 100, 0), (1700, 300, 0)])
    assert abs(r - 1464.06) < 0.05 and abs(d - 151.52) < 0.05 and abs(v - 0.05999) < 1e-4
    assert fold.glicko2(1500, 200, 0.06, [])[1] > 200


def test_standings_rise_with_wins_and_scope_fails_closed(spark):
    t = tallies(spark, [("a", "w1", "l1", 2, 2, 2.0, None), ("a", "w2", "l2", 1, 1, 1.0, None), ("b", "w1", "l1", 1, 1, 0.0, 3)])
    s = {r.claim: r for r in fold.standings(t).collect()}
    assert s["a"].rating > 1500 > s["b"].rating and s["a"].matches == 3
    assert fold.scoped(t, []).count() == 0 and fold.scoped(t, None).count() == 3 and fold.scoped(t, ["w2"]).count() == 1
    trusted = spark.createDataFrame([("w1", 1.0), ("w2", 1.0)], "witness string, trust double")
    # a trusted witness makes the same wins surer: the claim still holds more deviations below its rating
    held = [{r.claim: r.conf for r in fold.with_confidence(fold.standings(t, w)).collect()}["a"] for w in (None, trusted)]
    assert held[1] > held[0] and {r.claim: r.deviation for r in fold.standings(t, trusted).collect()}["a"] < s["a"].deviation
    full = {r.claim: r for r in fold.glicko2_standings(t).collect()}
    assert full["a"].rating > 1500 and full["a"].volatility == pytest.approx(0.06, abs=1e-3)


def test_tally_runs_and_positions(spark):
    obs = spark.createDataFrame([("c", "w", "l", 1, 0.5, 3, True, 0), ("c", "w", "l", 2, 1.0, 2, True, 4), ("d", "w", None, 1, 1.0, 5, False, 0)], "claim string, witness string, lineage string, record long, score double, run int, games boolean, position int")
    got = {r.claim: r for r in fold.tally(obs).collect()}
    assert (got["c"].games, got["c"].tokens, got["c"].wins, got["c"].position) == (5, 5, 3.5, 4)
    assert (got["d"].games, got["d"].tokens, got["d"].position) == (1, 5, None)
    assert fold.tally(obs.filter("false")).count() == 0


def test_forget_then_ingest_again_gives_the_same(spark):
    t = tallies(spark, [("a", "w1", "l", 1, 1, 1.0, None), ("b", "w2", "l", 1, 1, 1.0, None), ("a", "w2", "l", 1, 1, 0.0, None)])
    left, marks = fold.forget(t, ["w1"])
    assert [(r.claim, r.kept) for r in marks.collect()] == [("a", True)]
    again = left.unionByName(t.filter("witness = 'w1'"))
    assert fold.differing(fold.standings(t), fold.standings(again)).count() == 0


@pytest.mark.parametrize("amounts", [[1, 1, 1], [3, 2, 2, 1], [1], [997, 2, 1]])
def test_apportioned_points_sum_to_the_whole(spark, amounts):
    df = spark.createDataFrame([("k", f"n{i}", a) for i, a in enumerate(amounts)], "k string, name string, amount long")
    assert sum(r.bp for r in fold.apportion(df, "k", "name", "amount").collect()) == 10_000


def test_majority_tie_gives_none(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", "y")], "k string, v string")
    assert [(r.k, r.v) for r in fold.majority(df, "k", "v").collect()] == [("b", "x")]


CLAIMS = [("1", ["p", "r", "o"], 0.9), ("2", ["p", "q", "o"], 0.8), ("3", ["x", "p"], 0.7), ("4", ["p", "i1", "i2", "r", "z"], 0.6), ("5", ["p", "r", "o2"], 0.9)]


@pytest.fixture
def claims(spark):
    return spark.createDataFrame(CLAIMS, "claim string, parts array<string>, conf double")


def test_claim_lookup(spark, claims):
    keyed = spark.createDataFrame([(0, "p"), (1, "p"), (2, "none")], "src int, key string")
    got = C.claims_each(claims, keyed, "any", None, 2).collect()
    assert sorted((r.src, r.claim) for r in got) == [(0, "1"), (0, "5"), (1, "1"), (1, "5")]
    assert {r.claim for r in C.claims_each(claims, keyed.filter("src = 0"), "last").collect()} == {"3"}
    assert {r.claim for r in C.claims_each(claims, keyed.filter("src = 0"), "first", "r").collect()} == {"1", "4", "5"}
    assert [r.claim for r in C.claims_like(claims, ["p", "r", None]).collect()] == ["1", "5", "4"]
    assert [r.claim for r in C.claims_like(claims, [None, None, "o"], 1).collect()] == ["1"]


def test_refusal_comes_before_the_cap(spark, claims):
    keyed = spark.createDataFrame([(0, "p")], "src int, key string")
    kept = C.refuse_predicates(claims, ["r"])
    assert [r.claim for r in C.claims_each(kept, keyed, fan=1).collect()] == ["2"]
    assert {r.claim for r in kept.collect()} == {"2", "3"}
    assert {r.claim for r in C.only_predicates(claims, ["q"]).collect()} == {"2"}
    w = {r.claim: r.conf for r in C.weigh(claims, {"r": 0.5, "i1": 0.25, "p": 0.1}).collect()}
    assert w["1"] == 0.45 and w["4"] == 0.15 and w["3"] == 0.7 and w["2"] == 0.8
    t = tallies(spark, [("1", "a", "l", 1, 1, 1.0, None), ("2", "a", "l", 1, 1, 1.0, None), ("2", "b", "l", 1, 1, 1.0, None)])
    assert {r.claim for r in C.refuse_witnesses(claims, t, ["a"]).collect()} == {"2", "3", "4", "5"}


def test_positions_said_or_found_in_the_subjects_path(spark, claims):
    t = tallies(spark, [("1", "a", "l", 1, 1, 1.0, 7), ("1", "b", "l", 1, 1, 1.0, 4)])
    paths = spark.createDataFrame([("u", ["p", "2", "5"]), ("v", ["other", "5"])], "parent string, path array<string>")
    assert {r.claim: r.position for r in C.positions(claims, t, paths).collect()} == {"1": 4, "2": 2, "3": None, "4": None, "5": 3}


def test_chains_try_alternatives(spark):
    rows = spark.createDataFrame([("1", ["a", "lemma", "b"], 0.9, 2), ("2", ["a", "lemma", "c"], 0.8, 1), ("3", ["c", "sense", "d"], 0.9, None), ("4", ["e", "sense", "f"], 0.5, None)], "claim string, parts array<string>, conf double, position int")
    starts = spark.createDataFrame([("a",), ("e",), ("g",)], "origin string")
    got = {r.origin: (r.node, r.alternative) for r in C.chain(rows, starts, [["sense"], ["lemma", "sense"]]).collect()}
    assert got == {"e": ("f", 0), "a": ("d", 1)}


def test_wide_claims_are_found_by_any_part(spark):
    parts = [f"p{i}" for i in range(5003)]
    wide = spark.createDataFrame([("w", parts, 0.9)], "claim string, parts array<string>, conf double")
    for k in ("p0", "p80", "p5002"):
        assert C.claims_each(wide, spark.createDataFrame([(0, k)], "src int, key string")).count() == 1
    assert wide.select(core.other_end(F.col("parts"), F.lit("p5002")).alias("x")).first().x == "p0"


def test_containment(spark):
    paths = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, []), (4, ["b", "a"])], "parent long, path array<string>")
    held = K.explode_paths(paths)
    assert {r.child: (r.holders, r.occurrences) for r in K.holder_counts(held).collect()} == {"a": (3, 4), "b": (2, 2), "c": (1, 1)}
    sets = spark.createDataFrame([(0, "a"), (0, "b"), (0, "a"), (1, "c"), (1, "z")], "set_id int, key string")
    assert sorted((r.set_id, r.parent) for r in K.holders_all(held, sets).collect()) == [(0, 1), (0, 4)]
    plain, hubs = K.holders_capped(held, 2)
    assert {r.child for r in hubs.collect()} == {"a"} and plain.filter("child = 'a'").count() == 0
    assert {(r.parent, r["first"], r["last"], r.length) for r in K.endpoints(paths).collect()} == {(1, "a", "a", 3), (2, "a", "c", 2), (4, "b", "a", 2)}
    edges = spark.createDataFrame([("x", "y", 2), ("y", "z", 3), ("x", "z", 1)], "child string, parent string, times long")
    roots = spark.createDataFrame([("z", 1)], "node string, occ long")
    assert {r.node: r.occ for r in K.multiplicity(edges, roots, 3).collect()} == {"z": 1, "y": 3, "x": 7}


def test_phrases(spark):
    paths = phrases.word_paths(spark.createDataFrame([(1, "To be or not to be"), (2, "to be sure"), (3, None)], "id long, text string"), "id")
    prompts = phrases.word_paths(spark.createDataFrame([(9, "want to be")], "id long, text string"), "id")
    got = {(r.segment, r.next): r.times for r in phrases.segments_forward(paths, prompts, 2).collect()}
    assert got == {("to", "be"): 3, ("be", "or"): 1, ("be", "sure"): 1, ("to be", "or"): 1, ("to be", "sure"): 1}
    assert [(r.n, r.next) for r in phrases.follows_suffix(paths, prompts, 3).collect()] == [(2, "or")]
    occ = spark.createDataFrame([(1, 1), (2, 5)], "parent long, occ long")
    wanted = spark.createDataFrame([("to be",)], "segment string")
    assert {r.next: r.occ for r in phrases.fills(paths, occ, wanted, 2).collect()} == {"or": 1, "sure": 5}
    s = {r.word: r.info_bits for r in phrases.salience(paths).collect()}
    assert s["sure"] > s["be"]
    p = phrases.polarity(spark.createDataFrame([(1, ["not", "so", "good", ".", "fine", "not", "a", "b", "c", "d"])], "parent long, path array<string>"), ["not"], ["."], 3)
    assert [r.negated for r in p.orderBy("pos").collect()] == [True, True, True, False, False, True, True, True, True, False]


def test_runs_round_trip(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "x array<string>").select("x", core.run_length(F.col("x")).alias("p"))
    rows = df.select("x", "p", core.expand_runs(F.col("p")).alias("y")).collect()
    assert all(list(r.x) == list(r.y) for r in rows) and [v.run for v in rows[0].p] == [2, 1, 1]


def test_degrees_hubs_are_reached_not_crossed(spark):
    e = [("a", "b", 0.9), ("b", "c", 0.9), ("c", "hub", 0.9), ("hub", "d", 0.9), *[("hub", f"n{i}", 0.9) for i in range(10)], ("a", "c", 0.5)]
    both = spark.createDataFrame(e + [(b, a, c) for a, b, c in e], "a string, b string, conf double")
    got = {r.node: r for r in graph.degrees(both, spark.createDataFrame([("a",)], "node string"), 5, 0.05, 5).collect()}
    assert "hub" in got and "d" not in got
    assert got["c"].hops == 2 and got["c"].conf == pytest.approx(0.81)
    far = {r.node for r in graph.degrees(both, spark.createDataFrame([("hub",)], "node string"), 1, 0.05, 5).collect()}
    assert {"c", "d", "n0", "n9"} <= far


def test_walks_are_deterministic_and_layers_share_force(spark):
    both = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "a", 1.0), ("c", "a", 1.0)], "a string, b string, conf double")
    start = spark.createDataFrame([("a",)], "node string")
    one, two = ({r.node: r.visits for r in graph.walks(both.repartition(n), start, 200, 1, 0.0, "s").collect()} for n in (1, 3))
    assert one == two and one["b"] > 5 * one["c"] and sum(one.values()) == 200
    cells = graph.layer(both, spark.createDataFrame([("a", 1.0)], "node string, force double"), 8)
    assert {r.node: round(r.force, 6) for r in cells.collect()} == {"a": 1.0, "b": 0.45, "c": 0.05}


def test_shapes():
    a, b = np.array([[0, 0], [1, 0], [2, 0]], float), np.array([[0, 1], [1, 1], [2, 1]], float)
    assert shape.frechet(a, b) == 1 and shape.dtw(a, b) == 1 and shape.edr(a, b, 0.5) == 3 and shape.edr(a, b, 1.0) == 0
    odd = np.array([[0, 0], [1, 9], [2, 0]], float)
    assert shape.frechet(odd, a) == 9 and shape.frechet_outliers(odd, a, 1) < 9 and shape.frechet_outliers(odd, a, 0) == 9


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = shape.nearest(df, df.filter("vec_id < 5"), 3).collect()
    for q in range(5):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = math.inf
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == list(np.argsort(d)[:3])
    assert shape.nearest(df, df.filter("false"), 3).count() == 0


def test_keys(spark):
    d = spark.createDataFrame([("k", 2, "late"), ("k", 1, None), ("m", 3, "x")], "key string, rank int, v string")
    assert {r.key: r.v for r in keys.first_declared(d, ["key"], ["rank"], ["v"]).collect()} == {"k": None, "m": "x"}
    links = spark.createDataFrame([(1, 2), (1, 999), (999, 2), (999, 998)], "f long, t long")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    kept, out = keys.admit(links, ["f", "t"], ids, "id")
    assert [(r.f, r.t) for r in kept.collect()] == [(1, 2)] and out.first().excluded == 3
    with pytest.raises(Exception, match="off its scale"):
        keys.scored(spark.createDataFrame([("7",)], "v string"), "v", 0, 1, strict=True).collect()


RECIPE = """
name bias
format tsv
names post group offensive source kinds
thing post
attest group
value group as "is about"
pair kinds
part kinds by "|"
when offensive is-not 0.0
relate says to source alone
score offensive from 0 to 1
default group none
omit extra
"""


def test_recipe(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("p one\tw\t1.0\ts\ta|b||p one\np two\tnone\t0.0\t\tc\n")
    r = recipe.parse(RECIPE)
    rows = recipe.read(spark, r, str(tmp_path / "x.tsv"))
    got = recipe.claims(rows, r).collect()
    assert sorted((tuple(x.parts), x.score) for x in got) == [(("p one", "a"), 1.0), (("p one", "b"), 1.0), (("p one", "is about", "w"), 1.0), (("p one", "says", "s"), 1.0), (("p two", "says"), 0.0)]
    assert recipe.unread(rows, r) == []
    more = rows.withColumn("stray", F.lit("x"))
    assert [(x.field, x.rows) for x in recipe.obligations(more, r).collect()] == [("stray", 2)]
    with pytest.raises(ValueError, match="unknown word"):
        recipe.parse("name x\nguess y")


def test_strict_recipe_refuses(spark):
    r = recipe.parse("names s v\nthing s\nattest v\nscore v from 0 to 1\nstrict")
    ok = spark.createDataFrame([("a", "0.5")], "s string, v string")
    assert recipe.claims(ok, r).first().score == 0.5
    for bad in ([("a", "7")], [("a", "")]):
        with pytest.raises(Exception, match="off its scale|attests nothing"):
            recipe.claims(spark.createDataFrame(bad, "s string, v string"), r).collect()


def test_line_recipe(spark):
    r = recipe.parse("format lines\nline ^(\\w+) is (\\w+)$")
    df = spark.createDataFrame([("water is wet",), ("nothing",)], "line string")
    assert [list(x.parts) for x in recipe.claims(df, r).collect()] == [["water", "wet"]]


def test_parameters():
    s = firmware.parse('k 3\nlambda 0.1\nrefuse predicate A B\nfor pull\nfan 10\nelect walks grounds\nshape edr 2\nweigh 0.5 X "Y Z"\ntake fact\nfor search\nhops 3\n')
    assert s.general.k == 3 and s.general.fan == 4096 and s.of("search").fan == 512 and s.of("search").hops == 3
    p = s.of("pull")
    assert p.fan == 10 and p.elect == ("walks", "grounds") and p.shape == ("edr", 2.0) and p.weigh == (("X", 0.5), ("Y Z", 0.5)) and p.refuse_predicate == ("A", "B")
    for bad in ("order sideways", "glow 3", "elect luck"):
        with pytest.raises(ValueError):
            firmware.parse(bad)


def test_hop_and_turn(spark):
    said = [("dog", "is a", "animal"), ("dog", "chases", "cat"), ("cat", "is a", "animal"), ("cat", "drinks", "milk")]
    obs = spark.createDataFrame([(list(p), "w", "l", i, 1.0, 1, False, i + 1) for i, p in enumerate(said)], "parts array<string>, witness string, lineage string, record long, score double, run int, games boolean, position int")
    obs = obs.withColumn("claim", core.content_id_of("parts"))
    known = forward.Knowledge(claim_table(obs), fold.tally(obs), paths=phrases.word_paths(spark.createDataFrame([(1, "the dog chases the cat")], "id long, text string"), "id"))
    fw = firmware.parse("walks 8\nsteps 2").general
    one = spark.createDataFrame([(0, "dog")], "src int, key string")
    assert [r.parts[-1] for r in forward.hop(known, one, fw, position="first").orderBy("rank").collect()] == ["animal", "cat"]
    assert forward.hop(known, one, fw, allowed=[]).count() == 0
    prompt = spark.createDataFrame([("q", ["dog", "chases"])], "prompt string, path array<string>")
    got = forward.turn(known, prompt, fw).collect()
    assert len(got) == 1 and got[0].node in {"animal", "cat", "the"}
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "hi"), (1, 3, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    assert forward.said(talk).select("claim").distinct().count() == 1


def test_sources(spark, tmp_path):
    found = readers.select_paths(["a/x.txt", "a/.git/c", "b/keep.log", "b/drop.log", "build/y", "a/s.csv", "a/s_detailed.csv"], "*.log\n!keep.log\nbuild/\n", prefer=[("s_detailed.csv", "s.csv")])
    assert found == ["a/s_detailed.csv", "a/x.txt", "b/keep.log"]
    assert readers.choose_recipe("x", "#!/usr/bin/env python3\n", {}, {"python3": "python"}) == "python" and readers.choose_recipe("y", " {", {}, {}) == "json"
    lines = spark.createDataFrame([("a\tis\tb\t0.5",), ("water\tis\twet",), ("x\tcompiles\t\t0",), ("t\\\tab\tis\to",)], "value string")
    got = {(r.subject, r.relation, r.object, r.score) for r in readers.statements(lines).collect()}
    assert got == {("a", "is", "b", 0.5), ("water", "is", "wet", 1.0), ("x", "compiles", None, 0.0), ("t\tab", "is", "o", 1.0)}
    for bad in ("only", "a\t\tb", "a\tis\tb\tyes", "a\tis\tb\t7", ""):
        with pytest.raises(Exception, match="not a statement"):
            readers.statements(spark.createDataFrame([(bad,)], "value string")).collect()


def test_treebank_and_counted_groups(spark):
    text = "# text = The dogs ran.\n1\tThe\tthe\tDET\t_\t_\t2\tdet\n2\tdogs\tdog\tNOUN\t_\t_\t3\tnsubj\n3\tran\trun\tVERB\t_\t_\t0\troot\n4\t.\t.\tPUNCT\t_\t_\t3\tpunct\n"
    s = readers.treebank(spark.createDataFrame([(text + "\n" + text,)], "value string"))
    assert s.count() == 2 and s.first().lemma == ["the", "dog", "run", "."]
    edges = readers.tree_edges(s.filter("sentence = 0")).orderBy("ordinal").collect()
    assert [(r["head"], r.dependent) for r in edges] == [("dogs", "The"), ("ran", "dogs"), (None, "ran"), ("ran", ".")]
    glued = s.limit(1).select(readers.surface(F.col("form"), F.transform("form", lambda f: f == "ran")).alias("t"), "text").first()
    assert glued.t == glued.text
    line = "00001740 03 n 02 entity 0 thing 1 002 ~ 00001930 n 0000 @ 00002000 v 0102 | that which is"
    g = readers.counted_groups(spark.createDataFrame([("  1 licence",), (line,)], "value string")).collect()
    assert len(g) == 1 and g[0].words == ["entity", "thing"] and [p.target for p in g[0].pointers] == ["00001930", "00002000"] and g[0].gloss == "that which is"


def test_books_turtle_and_frames(spark, tmp_path):
    text = "Title: A Tale\nAuthor: N. N.\n\n*** START OF THE PROJECT BOOK X ***\n\nBody here.\n\n*** END OF THE PROJECT BOOK X ***\nlicence"
    b = readers.book(spark.createDataFrame([(text,)], "value string")).first()
    assert (b.title, b.author, b.language, b.body) == ("A Tale", "N. N.", None, "Body here.")
    ttl = '@prefix a: <x> .\n<i1> a <Concept> ;\n  skos:definition "a b; c."@en ;\n  dc:source p:1, p:2 .\n'
    got = {(r.subject, r.predicate, r.object, r.language) for r in readers.turtle(spark.createDataFrame([(ttl,)], "value string")).collect()}
    assert got == {("i1", "a", "Concept", None), ("i1", "skos:definition", "a b; c.", "en"), ("i1", "dc:source", "p:1", None), ("i1", "dc:source", "p:2", None)}
    (tmp_path / "f.bin").write_bytes(b"".join(len(x).to_bytes(4, "little") + x for x in (b"ab", b"", b"xyz")))
    assert [bytes(r.payload) for r in readers.framed(spark, str(tmp_path / "f.bin")).orderBy("ordinal").collect()] == [b"ab", b"", b"xyz"]
    readers.write_tsv(spark.createDataFrame([("a\tb", "c\\", None)], "x string, y string, z string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "a\\tb\tc\\\\\t"


def test_stream_counts_each_file_once(spark, tmp_path):
    schema = "claim string, witness string, lineage string, record long, score double, run int, games boolean, position int"
    rows = [("c", "w", "l", 1, 1.0, 1, False, 0), ("d", "w", "l", 2, 0.5, 1, False, 0)]
    place = lambda x: str(tmp_path / x)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(place("in"))
    for _ in range(2):
        ingest.ingest(spark, place("in"), schema, lambda b: b, place("log"), place("state"))
    assert sorted((r.claim, r.games) for r in ingest.tallies(spark, place("log")).collect()) == [("c", 1), ("d", 1)]
    spark.createDataFrame([("c", "w", "l", 9, 0.0, 1, False, 0)], schema).coalesce(1).write.mode("append").parquet(place("in"))
    ingest.ingest(spark, place("in"), schema, lambda b: b, place("log"), place("state"))
    assert {r.claim: r.games for r in ingest.tallies(spark, place("log")).collect()} == {"c": 2, "d": 1}
    assert [(r.claim, r.wins) for r in ingest.tallies(spark, place("log"), supersede=True).collect()] == [("c", 0.0)]


def test_vocabularies(spark):
    names = spark.createDataFrame([("l", "b"), ("l", "a"), ("m", "z")], "list string, key string")
    one = vocabulary.freeze(names)
    two = vocabulary.freeze(names.unionByName(spark.createDataFrame([("l", "A"), ("n", "q")], "list string, key string")), one)
    assert {(r.list, r.key): r.slot for r in two.collect()} == {("l", "a"): 0, ("l", "b"): 1, ("m", "z"): 0, ("l", "A"): 2, ("n", "q"): 0}
    alias = spark.createDataFrame([("l", "y", "x"), ("l", "x", "a"), ("l", "lost", "nowhere")], "list string, alias string, key string")
    got = {r.key: r.slot for r in vocabulary.with_aliases(one.filter("list = 'l'"), alias).collect()}
    assert got == {"a": 0, "b": 1, "x": 0, "y": 0}
    pairs = spark.createDataFrame([("l", "a", "m", "z"), ("l", "b", "m", "z"), ("l", "b", "m", "w")], "list_a string, key_a string, list_b string, key_b string")
    both = vocabulary.edges_both_ways(pairs)
    assert both.count() == 6
    assert {r.key: r.target for r in vocabulary.crosswalk(one.filter("list = 'l'"), both, "m").collect()} == {"a": "z", "b": None}
    cps = vocabulary.codepoints(spark, spark.createDataFrame([("0041..0043", "Lu"), ("1F600", "So")], "span string, property string"))
    assert [(r.cp, r.property) for r in cps.orderBy("cp").collect()] == [(65, "Lu"), (66, "Lu"), (67, "Lu"), (128512, "So")]


def test_coordinates(spark):
    atoms = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0), ("b", 0.0, 1.0, 0.0, 0.0)], "id string, x double, y double, z double, m double")
    held = spark.createDataFrame([("a", "ab", 3, 1), ("b", "ab", 1, 1), ("ab", "top", 1, 2), ("b", "top", 1, 2)], "child string, parent string, run int, tier int")
    got = {r.id: (r.x, r.y) for r in coordinates.climb(held, atoms, 2).collect()}
    assert got["ab"] == (0.75, 0.25) and got["top"] == (0.375, 0.625)
    assert coordinates.audit(coordinates.climb(held, atoms, 2), coordinates.climb(held, atoms, 2)).count() == 0
    with pytest.raises(Exception, match="no coordinate"):
        coordinates.mean_coordinates(spark.createDataFrame([("zz", "p", 1)], "child string, parent string, run int"), atoms).collect()
    side = np.linspace(-1, 1, 8)
    grid = np.array([(x, y) for x in side for y in side])
    order = grid[np.argsort(coordinates.hilbert(grid, 3))]
    assert len({*coordinates.hilbert(grid, 3).tolist()}) == 64 and np.allclose(np.abs(np.diff(order, axis=0)).sum(1), side[1] - side[0])
    rows = coordinates.publication_order(coordinates.with_hilbert(atoms), 2)
    assert rows.count() == 2


def test_shapefiles(spark, tmp_path):
    point = struct.pack("<i2d", 1, -97.7431, 30.2672)
    box = struct.pack("<4d", 0, 0, 0, 0)
    poly = struct.pack("<i", 5) + box + struct.pack("<2i", 1, 4) + struct.pack("<i", 0) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    records = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate((point, poly, struct.pack("<i", 0))))
    (tmp_path / "t.shp").write_bytes(b"\0" * 100 + records)
    names = [b"Austin    ", b"Square    ", b"None      "]
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15
    (tmp_path / "t.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 3, 65, 11) + b"\0" * 20 + field + b"\x0d" + b"".join(b" " + n for n in names))
    got = [(r.shape_type, r.wkt, r.fields["NAME"]) for r in shapes.read(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [("Point", "POINT (-97.7431 30.2672)", "Austin"), ("Polygon", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "Square"), ("Null", None, "None")]
    with pytest.raises(ValueError, match="cut off"):
        list(shapes.geometries(b"\0" * 100 + records[:20]))


def test_closure_reaches_a_node_once_however_many_paths_and_edges(spark):
    ladder = [(f"{i}{a}", f"{i + 1}{b}") for i in range(8) for a in "xyz" for b in "xyz"] + [("8x", "0x")]  # 3^8 paths, and a cycle
    got = {(r.key, r.node): r.depth for r in K.closure(spark.createDataFrame(ladder, "child string, parent string"), spark.createDataFrame([("0x",)], "key string")).collect()}
    assert len(got) == 1 + 3 * 8 and all(d == int(n[0]) for (_, n), d in got.items())
    many = spark.range(1_200_000).selectExpr("concat('c', id) as child", "concat('p', id % 7) as parent")
    up = K.closure(many, many.select(F.col("child").alias("key")))
    assert up.groupBy("depth").count().orderBy("depth").collect() == [(0, 1_200_000), (1, 1_200_000)]
