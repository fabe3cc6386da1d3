import collections
import random
import re

import pytest

from attestry.llm import ngram_join as N


def brute(rows, width, num, den):
    sets, texts = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


def made(seed, n, lengths, edits, vocabulary):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice(lengths))] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(w))
            what = rng.randrange(3)
            if what == 0:
                w[k] = f"w{rng.randrange(vocabulary)}"
            elif what == 1 and len(w) > 1:
                del w[k]
            else:
                w.insert(k, f"w{rng.randrange(vocabulary)}")
        rows.append((i * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    ("seed", "lengths", "edits", "vocabulary", "width", "share"),
    [(1, [5, 9, 12, 20, 21, 22], 2, 30, 3, (90, 100)), (2, [12, 18, 24, 30, 60], 3, 2000, 3, (90, 100)), (3, [80, 150, 300], 6, 5000, 3, (90, 100)), (4, [6, 10, 14, 25, 60, 120], 3, 3000, 5, (80, 100))],
)
def test_components_equal_brute_force(spark, seed, lengths, edits, vocabulary, width, share):
    rows = made(seed, 240, lengths, edits, vocabulary)
    got = N.join_components(spark.createDataFrame(rows, "doc_id long, text string"), width, share).collect()
    assert sorted(map(tuple, got)) == brute(rows, width, *share)


def test_edge_rows(spark):
    long = " ".join(f"x{i % 997}y{i % 13}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A B"), (6, "a b c"), (7, "a"), (7, "a"), (8, long), (9, long + " end"), (10, "É b c"), (11, "é b c")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, cls string")
    got = sorted(map(tuple, N.join_components(df, 3, (90, 100)).collect()))
    assert got == brute(rows, 3, 90, 100)
    assert N.join_components(df.filter("false"), 3, (90, 100)).count() == 0


def test_keep_one_leaves_one_of_each_group(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:50], f"e{i}", *base[50:]]), "s") for i in range(20)] + [(50, "alone in the corpus it stands here", "s"), (51, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = N.keep_one(df, 5, (80, 100))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 50, 51]


def test_every_linked_pair_of_small_sizes_shares_a_subset():
    share = (90, 100)
    for s in range(1, 25):
        for t in range(s, 25):
            need = N.least_overlap(s, t, share)
            linked = need <= s and 100 * need >= 90 * (s + t - need)
            listed = any(x[:2] == (s, t) for x in N.subsets_of(s, 24, share)) or (s == t == need)
            assert linked == listed or (s == t and need == s), (s, t)


def test_keep_one_with_columns_of_any_name(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, 7), (2, text, 8), (3, "other words", 9)], "doc_id long, text string, __LOST int")
    got = N.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_boundary_is_the_cheapest_of_all_sizes():
    rng = random.Random(5)
    for share in ((90, 100), (80, 100)):
        for list_length in (1.0, 40.0, 2000.0):
            counts = {n: rng.randrange(1, 50) for n in range(1, 400) if rng.random() < 0.7}
            top = N.largest_light(max(counts), share, list_length)
            got = N.boundary({n: c for n, c in counts.items() if n <= top}, share, list_length)
            cost = [sum(c * (N.subsets_each(n, share) if n <= b else N.list_cost(n, share, list_length)) for n, c in counts.items()) for b in range(100)]
            assert cost[got] == pytest.approx(min(cost)) and top < 100
