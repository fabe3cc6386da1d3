import hashlib
import zlib

from attestry.llm import chat as C
from attestry.llm import sharding as S


def test_growing_moves_slots_into_the_new_shard_alone():
    before = S.owners_of(40)
    after = S.grow(before, 40)
    moved = [s for s in range(S.SLOTS) if before[s] != after[s]]
    assert {after[s] for s in moved} == {40} and len(moved) == S.SLOTS // 41
    sizes = [before.count(k) for k in range(40)]
    assert max(sizes) - min(sizes) <= 3


def test_rebalancing_edits_a_copy_and_evens_bytes():
    owners, size = S.owners_of(4, 64), [10 + (i * i) % 97 for i in range(64)]
    size[3] = 400
    after = S.rebalance(owners, size, 4)
    load = lambda m: [sum(b for b, k in zip(size, m, strict=True) if k == j) for j in range(4)]
    assert owners == S.owners_of(4, 64) and max(load(after)) - min(load(after)) < max(load(owners)) - min(load(owners))


def test_a_stored_map_is_edited_under_the_next_version(spark):
    placed = S.place(spark.createDataFrame([(i, "x" * (i % 90)) for i in range(3000)], "doc_id long, text string"))
    one = S.store_map(placed, {1: S.owners_of(8)})
    two = S.edit_map(one, 1, 8).toPandas()
    assert len(two) == 2 * S.SLOTS and set(two.version) == {1, 2} and two[two.version == 2].rows.sum() == 3000
    load = two.groupby(["version", "owner"]).bytes.sum()
    assert load[2].max() - load[2].min() <= load[1].max() - load[1].min()
    assert (two[two.version == 1].sort_values("vslot").owner.to_numpy() == S.owners_of(8)).all()


def test_shards(spark):
    rows = [(i, f"text {i}" if i % 7 else None, "a", "k") for i in range(2000)] + [(5, "again", "a", "k")] * 900 + [(None, "no id", None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, law string").repartition(5)
    got = S.shard(df, 40).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"key"} and got.shard.between(0, 39).all()
    assert (got.groupby("doc_id").shard.nunique() == 1).all()
    changed = got[got.grown_shard != got.shard]
    assert set(changed.grown_shard) == {40}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    one = got[got.doc_id == 6].iloc[0]
    assert one["size"] == len(b"text 6") + 16 and one.text_crc32 == zlib.crc32(b"text 6")
    none = got[got.doc_id == 7].iloc[0]
    assert none["size"] == 16 and none.text_crc32 == 0
    assert S.shard(df.filter("false"), 40).count() == 0


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a\\b <|im_end|> <\\|x"), (1, 2, "assistant", "é\n<|im_start|>user\n"), (2, 0, "assistant", "first"), (2, 1, "user", None),
    (3, 0, None, "x"), (4, 0, "user", "q"), (4, 1, "assistant", ""), (4, 1, "assistant", ""), (5, 1, "assistant", "b" * 300_000), (5, 0, "user", "late"),
]


def digests(turns):
    out = {}
    for c in sorted({t[0] for t in turns}):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_round_trip_masks_and_validity(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, loss string")
    out = C.segments(df)
    got = {r.conv_id: r for r in C.read_back(out).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == digests(TURNS)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    whole = out.filter("conv_id = 1").orderBy("ordinal", "segment").toPandas().text.str.cat()
    assert whole.count("<|im_start|>") == 3 and whole.count("<|im_end|>") == 3 and got[1].formatted_chars == len(whole)
    assert C.read_back(C.segments(df.filter("false"))).count() == 0
