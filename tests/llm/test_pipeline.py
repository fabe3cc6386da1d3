import collections
import importlib.util

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") is None else importlib.import_module("corpus_pipeline")

from attestry.llm import packing, toxicity  # noqa: E402
from attestry.llm.common import written  # noqa: E402
from tests.llm.test_decontaminate import brute as leaks  # noqa: E402
from tests.llm.test_ngram_join import brute as components  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.7}
        elif name == "exact_dedup":
            by = collections.defaultdict(list)
            for i, t in rows:
                by["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")].append(i)
            want = {max(x) for x in by.values()}
        elif name == "ngram_jaccard_join":
            want = {i for i, _, c in components(rows, 5, 80, 100) if i == c}
        elif name == "benchmark_decontamination":
            want = {i for i, _ in rows} - {x[0] for x in leaks(rows, bench)}
        else:
            want = {i for i, _ in rows}
        docs = written(stage(spark, docs, DATA), name)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == want, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and docs.count() == len(want)
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()
    assert packing.WINDOW > 0


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "empty")
    assert docs.count() == 0
