"""The star-schema tables as a claim graph: claims, observations, tallies and word paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import content_id_of, rescale
from ..operators import fold
from ..operators.phrases import word_paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores if they come in fewer splits than that: a small file is one row group, read by one task.
    What comes in many splits is left as it is."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < 2 * n else rows


def entity(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _observed(rows: DataFrame, parts: list, witness, lineage, record, score, position, run=None, games=False) -> DataFrame:
    return rows.select(
        F.array(*parts).alias("parts"),
        witness.alias("witness"),
        lineage.alias("lineage"),
        record.cast("long").alias("record"),
        score.cast("double").alias("score"),
        (F.lit(1) if run is None else run).cast("int").alias("run"),
        F.lit(games).alias("games"),
        position.cast("int").alias("position"),
    ).withColumn("claim", content_id_of("parts"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[part, supplied by, supplier], said by order lines: witness by line status, lineage by return flag."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_orderkey", "l_quantity", "l_linenumber"))
    return _observed(
        li, [entity("part", "l_partkey"), F.lit("supplied by"), entity("supplier", "l_suppkey")], F.concat(F.lit("status "), "l_linestatus"), F.concat(F.lit("flag "), "l_returnflag"),
        F.col("l_orderkey"), rescale(F.col("l_quantity"), 1, 50), F.col("l_linenumber"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[supplier, nation, n], [customer, nation, n], [n, region, r], each said by its own table."""
    s, c, n = (table(spark, sf_dir, x) for x in ("supplier", "customer", "nation"))
    one, zero = F.lit(1.0), F.lit(0)
    rows = _observed(s, [entity("supplier", "s_suppkey"), F.lit("nation"), entity("nation", "s_nationkey")], F.lit("suppliers"), F.lit("registry"), F.col("s_suppkey"), one, zero)
    rows = rows.unionByName(_observed(c, [entity("customer", "c_custkey"), F.lit("nation"), entity("nation", "c_nationkey")], F.lit("customers"), F.lit("registry"), F.col("c_custkey"), one, zero))
    return rows.unionByName(_observed(n, [entity("nation", "n_nationkey"), F.lit("region"), entity("region", "n_regionkey")], F.lit("nations"), F.lit("atlas"), F.col("n_nationkey"), one, zero))


def about_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[doc, language, l] and [doc, source, s], each source a witness; [doc, quality | toxic, v] said by the labels."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc, one, zero = entity("doc", "doc_id"), F.lit(1.0), F.lit(0)
    rows = _observed(d, [doc, F.lit("language"), F.col("lang")], F.col("source"), F.col("source"), F.col("doc_id"), one, zero)
    rows = rows.unionByName(_observed(d, [doc, F.lit("source"), F.col("source")], F.col("source"), F.col("source"), F.col("doc_id"), one, zero))
    for name in ("quality", "toxic"):
        rows = rows.unionByName(_observed(lab, [doc, F.lit(name), F.col(name).cast("string")], F.lit("labels"), F.lit("labels"), F.col("doc_id"), F.col(name), zero))
    return rows


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[language, used by, source]: a claim each source attests once per document, with independent lineages."""
    d = table(spark, sf_dir, "documents")
    lineage = F.concat(F.lit("line "), F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(5)).cast("string"))
    return _observed(d, [F.lit("text"), F.lit("is written in"), F.col("lang")], F.col("source"), lineage, F.col("doc_id"), F.least(F.lit(1.0), F.col("n_chars") / 2000), F.lit(0), F.lit(1) + F.pmod(F.col("doc_id"), F.lit(3)), True)


def claim_table(observations: DataFrame) -> DataFrame:
    return observations.groupBy("claim").agg(F.first("parts").alias("parts"))


def rated(observations: DataFrame, k: float = 2.0, by_subject: bool = False, trust: float = 0.5) -> DataFrame:
    """Claims with standing, confidence, games and least position: (claim, parts, subject, rating, deviation, matches,
    position, conf), from one read of the observations.

    A claim is named by its parts, so copies fold by parts and lineage, then lineages by parts, and ids are taken of what
    is left. With by_subject the second fold is dealt by subject, and windows over subjects move nothing more."""
    lineages = fold.tally(observations, ("parts", "lineage")).withColumn("t", F.lit(trust))
    if by_subject:
        rows = fold.rate(lineages.withColumn("subject", F.element_at("parts", 1)).repartition("subject"), ("subject", "parts"))
    else:
        rows = fold.rate(lineages, ("parts",)).withColumn("subject", F.element_at("parts", 1))
    return fold.with_confidence(rows.withColumn("claim", content_id_of("parts")), k)


def document_paths(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return word_paths(spread(table(spark, sf_dir, "documents").select("doc_id", "text", *keep)), "doc_id", keep=keep)


def benchmark_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_paths(table(spark, sf_dir, "benchmark"), "item_id")
