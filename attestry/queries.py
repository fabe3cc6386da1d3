"""Registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.core import INITIAL_DEVIATION, content_id, content_id_of, expand_runs, run_length
from .operators import claims as C
from .operators import containment as K
from .operators import fold, graph, keys, phrases, shape
from .plans import recipe as recipes
from .plans import tables as T
from .plans.tables import table
from .sources.work import workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL fragments of the oracle side

_ID = "substr(sha256(concat_ws(chr(31), {0})), 1, 32)"
_SUPPLY = f"""
supply AS (
  SELECT 'part:' || l_partkey AS s, 'supplied by' AS p, 'supplier:' || l_suppkey AS o,
         {_ID.format("'part:' || l_partkey, 'supplied by', 'supplier:' || l_suppkey")} AS claim,
         'status ' || l_linestatus AS witness, 'flag ' || l_returnflag AS lineage, l_orderkey AS record,
         greatest(0.0, least(1.0, (l_quantity - 1.0) / 49.0)) AS score, 1 AS run, false AS games, l_linenumber AS position
  FROM lineitem
)"""
_PLACES = f"""
places0 AS (
  SELECT 'supplier:' || s_suppkey AS s, 'nation' AS p, 'nation:' || s_nationkey AS o, 'suppliers' AS witness, 'registry' AS lineage, s_suppkey AS record FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation', 'nation:' || c_nationkey, 'customers', 'registry', c_custkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region', 'region:' || n_regionkey, 'nations', 'atlas', n_nationkey FROM nation
), places AS (
  SELECT s, p, o, {_ID.format("s, p, o")} AS claim, witness, lineage, record, 1.0::DOUBLE AS score, 1 AS run, false AS games, 0 AS position FROM places0
)"""
_DOCS = f"""
docs0 AS (
  SELECT 'doc:' || doc_id AS s, 'language' AS p, lang AS o, source AS witness, source AS lineage, doc_id AS record, 1.0::DOUBLE AS score FROM documents
  UNION ALL SELECT 'doc:' || doc_id, 'source', source, source, source, doc_id, 1.0 FROM documents
  UNION ALL SELECT 'doc:' || doc_id, 'quality', CAST(quality AS VARCHAR), 'labels', 'labels', doc_id, quality FROM labels
  UNION ALL SELECT 'doc:' || doc_id, 'toxic', CAST(toxic AS VARCHAR), 'labels', 'labels', doc_id, toxic FROM labels
), aboutdocs AS (
  SELECT s, p, o, {_ID.format("s, p, o")} AS claim, witness, lineage, record, score, 1 AS run, false AS games, 0 AS position FROM docs0
)"""
_LANGS = f"""
langs AS (
  SELECT 'text' AS s, 'is written in' AS p, lang AS o, {_ID.format("'text', 'is written in', lang")} AS claim, source AS witness,
         'line ' || (CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 5) AS lineage, doc_id AS record,
         least(1.0, n_chars / 2000.0) AS score, 1 + doc_id % 3 AS run, true AS games, 0 AS position
  FROM documents
)"""


def _tally_sql(source: str, name: str = "tally") -> str:
    return f"""
{name} AS (
  SELECT claim, witness, lineage, CAST(sum(CASE WHEN games THEN run ELSE 1 END) AS BIGINT) AS games, CAST(sum(run) AS BIGINT) AS tokens,
         sum(score * CASE WHEN games THEN run ELSE 1 END) AS wins, min(nullif(position, 0)) AS position
  FROM {source} GROUP BY claim, witness, lineage
)"""


_Q2 = (math.log(10) / 400) ** 2


def _standing_sql(tally: str = "tally", name: str = "standing", trust: float = 0.5, k: float = 2.0) -> str:
    d = 30 + 160 * (1 - trust)
    g = 1 / math.sqrt(1 + 3 * _Q2 * d * d / math.pi**2)
    return f"""
{name}_l AS (SELECT claim, lineage, sum(games) AS games, sum(wins) / sum(games) AS s FROM {tally} GROUP BY claim, lineage),
{name}_c AS (
  SELECT claim, count(*) * {g * g!r}::DOUBLE AS info, {g!r}::DOUBLE * sum(s - 0.5) AS gain, CAST(sum(games) AS BIGINT) AS matches FROM {name}_l GROUP BY claim
), {name}_r AS (
  SELECT claim, 1500 + {math.sqrt(_Q2)!r}::DOUBLE * gain / ({1 / INITIAL_DEVIATION**2!r}::DOUBLE + {_Q2 / 4!r}::DOUBLE * info) AS rating,
         sqrt(1 / ({1 / INITIAL_DEVIATION**2!r}::DOUBLE + {_Q2 / 4!r}::DOUBLE * info)) AS deviation, matches FROM {name}_c
), {name} AS (
  SELECT claim, rating, deviation, matches, round(1 / (1 + pow(10.0, (1500 - (rating - {k} * deviation)) / 400.0)), 9) AS conf FROM {name}_r
)"""


def _claims_sql(source: str) -> str:
    return f"claims AS (SELECT claim, s, p, o FROM {source} GROUP BY claim, s, p, o)"


def _words_sql(source: str = "documents", key: str = "doc_id", name: str = "w") -> str:
    return f"""
{name} AS (
  SELECT parent, pos, word FROM (
    SELECT {key} AS parent, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{Nd}}]+')) AS word,
           generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{Nd}}]+'), 1) - 1 AS pos
    FROM {source}
  )
)"""


# ---------------------------------------------------------------- testimony


@register(f"WITH {_SUPPLY}, {_tally_sql('supply')} SELECT claim, witness, lineage, games, tokens, round(wins, 6) AS wins, CAST(position AS INT) AS position FROM tally")
def claims_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.tally(T.supply(spark, sf_dir)).withColumn("wins", F.round("wins", 6))


@register(f"WITH {_LANGS}, {_tally_sql('langs')} SELECT claim, witness, lineage, games, tokens, round(wins, 6) AS wins FROM tally")
def games_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.tally(T.languages(spark, sf_dir)).select("claim", "witness", "lineage", "games", "tokens", F.round("wins", 6).alias("wins"))


@register(
    f"""SELECT {_ID.format("'user:' || user_id, event_type")} AS claim, 'log' AS witness, 'log' AS lineage, user_id AS record, CAST(count(*) AS INT) AS run
    FROM events GROUP BY user_id, event_type"""
)
def record_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    said = ev.select(content_id(F.concat(F.lit("user:"), F.col("user_id").cast("string")), "event_type").alias("claim"), F.lit("log").alias("witness"), F.lit("log").alias("lineage"), F.col("user_id").alias("record"), F.lit(1.0).alias("score"), F.lit(0).alias("position"))
    return fold.dedupe_records(said).select("claim", "witness", "lineage", "record", "run")


@register(f"WITH {_SUPPLY}, {_tally_sql('supply')}, {_standing_sql()} SELECT claim, round(rating, 4) AS rating, round(deviation, 4) AS deviation, matches, round(conf, 6) AS conf FROM standing")
def standing_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold.with_confidence(fold.standings(fold.tally(T.supply(spark, sf_dir))))
    return rows.select("claim", F.round("rating", 4).alias("rating"), F.round("deviation", 4).alias("deviation"), "matches", F.round("conf", 6).alias("conf"))


@register(
    f"""WITH {_LANGS}, {_tally_sql("langs")}, scoped AS (SELECT * FROM tally WHERE witness IN ('src1', 'src2', 'src3')), {_standing_sql("scoped")}
    SELECT claim, round(rating, 4) AS rating, round(deviation, 4) AS deviation, matches FROM standing"""
)
def scoped_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold.standings(fold.scoped(fold.tally(T.languages(spark, sf_dir)), ["src1", "src2", "src3"]))
    return rows.select("claim", F.round("rating", 4).alias("rating"), F.round("deviation", 4).alias("deviation"), "matches")


@register(f"WITH {_LANGS}, {_tally_sql('langs')} SELECT claim, witness, games FROM tally WHERE false")
def empty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.scoped(fold.tally(T.languages(spark, sf_dir)), []).select("claim", "witness", "games")


@register(
    f"""WITH {_DOCS}, {_tally_sql("aboutdocs")} SELECT claim, witness, CAST(sum(games) AS BIGINT) AS games, CAST(sum(tokens) AS BIGINT) AS tokens,
    round(sum(wins) / sum(games), 6) AS mean_score FROM tally GROUP BY claim, witness"""
)
def held_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold.provenance(fold.tally(T.about_documents(spark, sf_dir)))
    return rows.select("claim", "witness", "games", "tokens", F.round("mean_score", 6).alias("mean_score"))


@register(
    f"""WITH {_LANGS}, {_tally_sql("langs")}, kept AS (SELECT * FROM tally WHERE witness NOT IN ('src0', 'src7')), {_standing_sql("kept")}
    SELECT claim, round(rating, 4) AS rating, matches FROM standing"""
)
def forget_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = fold.forget(fold.tally(T.languages(spark, sf_dir)), ["src0", "src7"])
    return fold.standings(left).select("claim", F.round("rating", 4).alias("rating"), "matches")


@register(
    f"""WITH {_DOCS}, {_tally_sql("aboutdocs")} SELECT claim, bool_or(witness NOT IN ('labels', 'src3')) AS kept FROM tally
    GROUP BY claim HAVING bool_or(witness IN ('labels', 'src3'))"""
)
def forget_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.forget(fold.tally(T.about_documents(spark, sf_dir)), ["labels", "src3"])[1]


@register(
    f"""WITH {_DOCS}, part AS (SELECT s AS id, witness FROM aboutdocs UNION ALL SELECT p, witness FROM aboutdocs UNION ALL SELECT o, witness FROM aboutdocs)
    SELECT id FROM part GROUP BY id HAVING bool_and(witness = 'labels')"""
)
def sweep_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = T.about_documents(spark, sf_dir)
    entities = obs.select(F.explode("parts").alias("id")).distinct()
    return fold.sweep(entities, obs.filter("witness <> 'labels'").select(F.explode("parts").alias("part")))


@register("SELECT CAST(0 AS BIGINT) AS differing")
def replay_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings folded at once, and from partial tallies of parts of the input merged as windows are, agree."""
    obs = T.supply(spark, sf_dir)
    by = ("parts", "witness", "lineage")  # parts name a claim as its id does; tallies are dealt by them once, for all that follows
    whole = fold.tally(obs, by).repartition("parts")
    windows = fold.tally(obs.filter(F.col("record") % 2 == 0), by).unionByName(fold.tally(obs.filter(F.col("record") % 2 == 1), by)).repartition("parts")
    merged = windows.groupBy(*by).agg(F.sum("games").alias("games"), F.sum("tokens").alias("tokens"), F.sum("wins").alias("wins"), F.min("position").alias("position"))
    a, b = (fold.standings(t, claim="parts").select("parts", F.round("rating", 6).alias("rating"), F.round("deviation", 6).alias("deviation"), "matches") for t in (whole, merged))
    return fold.differing(a, b, "parts", unique=True).agg(F.count("*").alias("differing"))


@register(
    f"""WITH {_LANGS}, {_tally_sql("langs")}, a AS (SELECT claim, lineage, sum(games) AS amount FROM tally GROUP BY claim, lineage),
    e AS (SELECT *, amount * 10000.0 / sum(amount) OVER (PARTITION BY claim) AS exact FROM a),
    f AS (SELECT *, floor(exact) AS base, 10000 - sum(floor(exact)) OVER (PARTITION BY claim) AS short FROM e)
    SELECT claim, lineage, CAST(base + CASE WHEN row_number() OVER (PARTITION BY claim ORDER BY round(exact - base, 9) DESC, amount DESC, lineage) <= short THEN 1 ELSE 0 END AS BIGINT) AS bp FROM f"""
)
def witness_share_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.apportion(fold.tally(T.languages(spark, sf_dir)), "claim", "lineage", "games")


@register(
    f"""WITH {_LANGS}, n AS (SELECT o AS namespace, claim, count(DISTINCT lineage) AS n FROM langs GROUP BY o, claim)
    SELECT namespace, count(*) AS attested, count(*) FILTER (WHERE n >= 2) AS by2, count(*) FILTER (WHERE n >= 3) AS by3, count(*) FILTER (WHERE n >= 4) AS by4 FROM n GROUP BY namespace"""
)
def lineage_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.lineage_counts(T.languages(spark, sf_dir).withColumn("namespace", F.element_at("parts", 3)), "namespace")


@register(
    """WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2), m AS (SELECT *, max(votes) OVER (PARTITION BY user_id) AS top FROM v)
    SELECT user_id, min(event_type) AS event_type, max(votes) AS votes FROM m WHERE votes = top GROUP BY user_id HAVING count(*) = 1"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.majority(table(spark, sf_dir, "events"), "user_id", "event_type")


@register(
    f"""WITH {_DOCS} SELECT witness, count(DISTINCT claim) AS claims, count(*) AS observations, count(DISTINCT claim) FILTER (WHERE score >= 0.5) AS won FROM aboutdocs GROUP BY witness"""
)
def estate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = T.about_documents(spark, sf_dir)
    return obs.groupBy("witness").agg(F.count_distinct("claim").alias("claims"), F.count("*").alias("observations"), F.count_distinct(F.when(F.col("score") >= 0.5, F.col("claim"))).alias("won"))


# ---------------------------------------------------------------- claim lookup


def _rated_sql(source_cte: str, source: str) -> str:
    return f"{source_cte}, {_tally_sql(source)}, {_standing_sql()}, {_claims_sql(source)}, rated AS (SELECT c.*, r.conf FROM claims c JOIN standing r USING (claim))"


@register(
    f"""WITH {_rated_sql(_SUPPLY, "supply")}, e AS (SELECT s AS src, claim, conf FROM rated UNION SELECT o, claim, conf FROM rated),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY conf DESC, claim) AS rank FROM e) SELECT src, claim, round(conf, 6) AS conf, CAST(rank AS INT) AS rank FROM r WHERE rank <= 24"""
)
def hop_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything attested about each part and supplier, the first 24."""
    got = C.claims_each(T.rated(T.supply(spark, sf_dir)), None, "ends", fan=24, keep=[])
    return got.select("src", "claim", F.round("conf", 6).alias("conf"), "rank")


@register(
    f"""WITH {_rated_sql(_SUPPLY, "supply")}, r AS (SELECT s AS src, o AS object, conf, claim, row_number() OVER (PARTITION BY s ORDER BY conf DESC, claim) AS rank FROM rated WHERE p = 'supplied by')
    SELECT src, object, round(conf, 6) AS conf FROM r WHERE rank <= 3"""
)
def hop_open_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rated(T.supply(spark, sf_dir), by_subject=True).withColumn("object", F.element_at("parts", -1))
    return C.claims_each(rows, None, "first", "supplied by", 3, ["object"]).select("src", "object", F.round("conf", 6).alias("conf"))


@register(
    f"""WITH {_rated_sql(_SUPPLY, "supply")}, r AS (SELECT o AS src, s AS subject, conf, claim, row_number() OVER (PARTITION BY o ORDER BY conf DESC, claim) AS rank FROM rated)
    SELECT src, subject, round(conf, 6) AS conf FROM r WHERE rank <= 5"""
)
def hop_open_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.claims_each(T.rated(T.supply(spark, sf_dir)), None, "last", "supplied by", 5, ["subject"])
    return got.select("src", "subject", F.round("conf", 6).alias("conf"))


@register(f"WITH {_rated_sql(_PLACES, 'places')}, r AS (SELECT claim, conf FROM rated WHERE p = 'nation' AND o = 'nation:7') SELECT claim, round(conf, 6) AS conf FROM r ORDER BY conf DESC, claim LIMIT 24")
def claims_like_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claims_like(T.rated(T.places(spark, sf_dir)), [None, "nation", "nation:7"], 24).select("claim", F.round("conf", 6).alias("conf"))


@register(f"WITH {_rated_sql(_DOCS, 'aboutdocs')} SELECT claim, round(conf, 6) AS conf FROM rated WHERE p NOT IN ('source', 'toxic')")
def refused_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.refuse_predicates(T.rated(T.about_documents(spark, sf_dir)), ["source", "toxic"])
    return rows.select("claim", F.round("conf", 6).alias("conf"))


@register(f"WITH {_DOCS}, {_tally_sql('aboutdocs')} SELECT claim FROM tally GROUP BY claim HAVING NOT bool_and(witness IN ('labels', 'src5'))")
def refused_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = T.about_documents(spark, sf_dir)
    return C.refuse_witnesses(T.claim_table(obs), fold.tally(obs), ["labels", "src5"]).select("claim")


@register(f"WITH {_rated_sql(_DOCS, 'aboutdocs')} SELECT claim, round(conf * CASE p WHEN 'source' THEN 0.5 WHEN 'language' THEN 0.25 ELSE 1.0 END, 6) AS conf FROM rated")
def strand_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.weigh(T.rated(T.about_documents(spark, sf_dir)), {"source": 0.5, "language": 0.25})
    return rows.select("claim", F.round("conf", 6).alias("conf"))


@register(
    f"""WITH {_rated_sql(_SUPPLY, "supply")}, pos AS (SELECT claim, min(position) AS position FROM tally GROUP BY claim),
    r AS (SELECT s AS src, claim, position, row_number() OVER (PARTITION BY s ORDER BY position ASC NULLS LAST, conf DESC, claim) AS rank FROM rated JOIN pos USING (claim))
    SELECT src, claim, CAST(position AS INT) AS position, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""
)
def positions_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rated(T.supply(spark, sf_dir), by_subject=True).select(F.col("subject").alias("src"), "claim", "position", "conf")
    return C.top(rows, ["src"], 3, C.by_position()).select("src", "claim", "position", "rank")


@register(
    f"""WITH {_SUPPLY}, {_PLACES}, alls AS (SELECT * FROM supply UNION ALL SELECT * FROM places), {_tally_sql("alls")}, {_standing_sql()}, {_claims_sql("alls")},
    pos AS (SELECT claim, min(position) AS position FROM tally GROUP BY claim), rated AS (SELECT c.*, r.conf, position FROM claims c JOIN standing r USING (claim) JOIN pos USING (claim)),
    b AS (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY position ASC NULLS LAST, conf DESC, claim) AS k FROM rated)
    SELECT x.s AS origin, z.o AS node FROM b x JOIN b y ON y.s = x.o AND y.p = 'nation' AND y.k = 1 JOIN b z ON z.s = y.o AND z.p = 'region' AND z.k = 1 WHERE x.p = 'supplied by' AND x.k = 1"""
)
def chain_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rated(T.supply(spark, sf_dir).unionByName(T.places(spark, sf_dir)), by_subject=True)
    parts = table(spark, sf_dir, "part").select(T.entity("part", "p_partkey").alias("origin"))
    return C.chain(rows, parts, [["supplied by", "nation", "region"]]).select("origin", "node")


@register(
    """WITH lex AS (SELECT p_name AS lemma, p_brand AS language, p_type AS concept, count(*) AS uses, min(p_size) AS conf FROM part GROUP BY 1, 2, 3),
    r AS (SELECT a.lemma AS word, a.language AS "from", a.concept, b.language AS "to", b.lemma AS translation, b.uses,
            row_number() OVER (PARTITION BY a.lemma, a.language, a.concept, b.language ORDER BY b.uses DESC, b.conf DESC, b.lemma) AS rank
          FROM lex a JOIN lex b ON a.concept = b.concept AND a.language <> b.language)
    SELECT word, "from", concept, "to", translation, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"""
)
def translate_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one brand to names of another through the type they share."""
    lex = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("lemma"), F.col("p_brand").alias("language"), F.col("p_type").alias("concept")).agg(F.count("*").alias("uses"), F.min("p_size").alias("conf"))
    same = spark.createDataFrame([], "a string, b string")
    return C.translate(lex, same, 8).select("word", "from", "concept", "to", "translation", "rank")


@register(
    """WITH p(a, b) AS (SELECT * FROM (VALUES ('en', 'eng'), ('eng', 'english'), ('fr', 'fra'), ('fre', 'fra'), ('de', 'deu'), ('ger', 'deu')) t(a, b)),
    both_ AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r0 AS (SELECT DISTINCT a, a AS b FROM both_),
    r1 AS (SELECT * FROM r0 UNION SELECT r0.a, x.b FROM r0 JOIN both_ x ON x.a = r0.b), r2 AS (SELECT * FROM r1 UNION SELECT r1.a, x.b FROM r1 JOIN both_ x ON x.a = r1.b)
    SELECT lang, b AS code, count(*) AS documents FROM documents JOIN r2 ON r2.a = lang GROUP BY lang, b"""
)
def language_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("en", "eng"), ("eng", "english"), ("fr", "fra"), ("fre", "fra"), ("de", "deu"), ("ger", "deu")], "a string, b string")
    near = C.language_closure(spark, pairs)
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"))
    return docs.join(near, docs.lang == near.a).select("lang", F.col("b").alias("code"), "documents")


# ---------------------------------------------------------------- containment


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.explode_paths(T.document_paths(spark, sf_dir))


@register(f"WITH {_words_sql()} SELECT word AS child, count(DISTINCT parent) AS holders, count(*) AS occurrences FROM w GROUP BY word")
def holder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.path_holder_counts(T.document_paths(spark, sf_dir))


@register(
    f"""WITH {_words_sql()}, e AS (SELECT parent, max(pos) AS last FROM w GROUP BY parent)
    SELECT e.parent, a.word AS first, b.word AS last, CAST(e.last + 1 AS INT) AS length FROM e JOIN w a ON a.parent = e.parent AND a.pos = 0 JOIN w b ON b.parent = e.parent AND b.pos = e.last"""
)
def path_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.endpoints(T.document_paths(spark, sf_dir))


@register(
    f"""WITH {_words_sql()}, {_words_sql("benchmark", "item_id", "b")}, k AS (SELECT DISTINCT parent AS set_id, word FROM b), n AS (SELECT set_id, count(*) AS n FROM k GROUP BY set_id),
    h AS (SELECT DISTINCT parent, word FROM w), g AS (SELECT set_id, parent, count(*) AS m FROM h JOIN k USING (word) GROUP BY set_id, parent)
    SELECT g.set_id, g.parent FROM g JOIN n USING (set_id) WHERE m = n"""
)
def holders_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every word of a benchmark item."""
    sets = K.explode_paths(T.benchmark_paths(spark, sf_dir)).select(F.col("parent").alias("set_id"), F.col("child").alias("key"))
    return K.path_holders_all(T.document_paths(spark, sf_dir), sets)


@register(
    f"""WITH {_words_sql()}, {_words_sql("benchmark", "item_id", "b")}, p AS (SELECT DISTINCT x.word AS a, y.word AS b FROM b x JOIN b y ON x.parent = y.parent AND y.pos = x.pos + 1),
    h AS (SELECT DISTINCT parent, word FROM w) SELECT a, b, count(*) AS parents FROM p JOIN h x ON x.word = a JOIN h y ON y.word = b AND y.parent = x.parent GROUP BY a, b"""
)
def holders_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold both words of each adjacent pair of the benchmark."""
    grams = phrases.ngrams(T.benchmark_paths(spark, sf_dir), 1).filter("next is not null")
    pairs = grams.select(F.col("segment").alias("a"), F.col("next").alias("b"))
    return K.path_holders_pair(T.document_paths(spark, sf_dir), pairs).groupBy("a", "b").agg(F.count("*").alias("parents"))


@register(f"WITH {_words_sql()}, h AS (SELECT DISTINCT parent, word FROM w), n AS (SELECT word, count(*) AS n FROM h GROUP BY word) SELECT word AS child, parent FROM h JOIN n USING (word) WHERE n <= 20")
def holders_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.path_holders_capped(T.document_paths(spark, sf_dir), 20)[0]


@register(f"WITH {_words_sql()}, n AS (SELECT word AS child, count(DISTINCT parent) AS holders FROM w GROUP BY word) SELECT * FROM n WHERE holders > 20")
def hub_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.holders_capped(_document_words(spark, sf_dir), 20)[1]


_EDGES = """
edges AS (
  SELECT 'customer:' || c_custkey AS child, 'nation:' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'world' FROM region
)"""


def _place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.places(spark, sf_dir).select(F.element_at("parts", 1).alias("child"), F.element_at("parts", -1).alias("parent"))
    return rows.unionByName(table(spark, sf_dir, "region").select(T.entity("region", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@register(
    f"""WITH RECURSIVE {_EDGES}, up(key, node, depth) AS (SELECT DISTINCT child, child, 0 FROM edges WHERE child LIKE 'supplier:%' UNION ALL SELECT u.key, e.parent, u.depth + 1 FROM up u JOIN edges e ON e.child = u.node)
    SELECT key, node, min(depth) AS depth FROM up GROUP BY key, node"""
)
def closure_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _place_edges(spark, sf_dir)
    return K.closure(edges, edges.filter("child like 'supplier:%'").select(F.col("child").alias("key")).distinct())


@register(
    f"""WITH RECURSIVE {_EDGES}, up(key, node, depth) AS (SELECT DISTINCT child, child, 0 FROM edges WHERE child LIKE 'supplier:%' OR child LIKE 'customer:%' UNION ALL SELECT u.key, e.parent, u.depth + 1 FROM up u JOIN edges e ON e.child = u.node),
    pairs AS (SELECT c_custkey AS g, 'customer:' || c_custkey AS key FROM customer JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, 'supplier:' || s_suppkey FROM customer JOIN supplier ON s_suppkey = c_custkey),
    r AS (SELECT g, node, sum(depth) AS depth, count(DISTINCT key) AS n FROM pairs JOIN up USING (key) GROUP BY g, node),
    f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY depth, node) AS k FROM r WHERE n = 2) SELECT g, node, CAST(depth AS BIGINT) AS depth FROM f WHERE k = 1"""
)
def held_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest unit that holds both the customer and the supplier of each shared number."""
    edges = _place_edges(spark, sf_dir)
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey"))
    pairs = both.select(F.col("c_custkey").alias("g"), F.explode(F.array(T.entity("customer", "c_custkey"), T.entity("supplier", "s_suppkey"))).alias("key"))
    reached = K.closure(edges, pairs.select("key").distinct()).join(pairs, "key")
    return K.common_unit(reached, "g", 2)


@register(
    """WITH RECURSIVE e AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent, 1 AS times FROM nation
      UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1 FROM supplier
      UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, count(*) FROM lineitem GROUP BY l_partkey, l_suppkey),
    d AS (SELECT 'region:' || r_regionkey AS node, 1::HUGEINT AS occ FROM region UNION ALL SELECT e.child, d.occ * e.times FROM d JOIN e ON e.parent = d.node)
    SELECT node, CAST(sum(occ) AS BIGINT) AS occ FROM d GROUP BY node"""
)
def dag_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every node below the regions, down to parts."""
    n, s, li = (table(spark, sf_dir, x) for x in ("nation", "supplier", "lineitem"))
    one = F.lit(1).cast("long").alias("times")
    e = n.select(T.entity("nation", "n_nationkey").alias("child"), T.entity("region", "n_regionkey").alias("parent"), one)
    e = e.unionByName(s.select(T.entity("supplier", "s_suppkey").alias("child"), T.entity("nation", "s_nationkey").alias("parent"), one))
    e = e.unionByName(li.select(T.entity("part", "l_partkey").alias("child"), T.entity("supplier", "l_suppkey").alias("parent"), one))
    roots = table(spark, sf_dir, "region").select(T.entity("region", "r_regionkey").alias("node"), F.lit(1).alias("occ"))
    return K.multiplicity(e, roots)


# ---------------------------------------------------------------- text


def _grams_sql(n: int, source: str, name: str) -> str:
    words = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(n + 1))
    seg = " || ' ' || ".join(f"w{i}" for i in range(n))
    return f"{name} AS (SELECT parent, pos, {seg} AS segment, w{n} AS next FROM (SELECT parent, pos, {words} FROM {source} WINDOW o AS (PARTITION BY parent ORDER BY pos)) WHERE w{n - 1} IS NOT NULL)"


_B = _words_sql("benchmark", "item_id", "b")


@register(
    f"""WITH {_words_sql()}, {_B}, {_grams_sql(1, "w", "g1")}, {_grams_sql(2, "w", "g2")}, {_grams_sql(3, "w", "g3")}, {_grams_sql(1, "b", "q1")}, {_grams_sql(2, "b", "q2")}, {_grams_sql(3, "b", "q3")}
    SELECT segment, next, count(*) AS times, 1 AS n FROM g1 WHERE next IS NOT NULL AND segment IN (SELECT segment FROM q1) GROUP BY segment, next
    UNION ALL SELECT segment, next, count(*), 2 FROM g2 WHERE next IS NOT NULL AND segment IN (SELECT segment FROM q2) GROUP BY segment, next
    UNION ALL SELECT segment, next, count(*), 3 FROM g3 WHERE next IS NOT NULL AND segment IN (SELECT segment FROM q3) GROUP BY segment, next"""
)
def segments_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.segments_forward(T.document_paths(spark, sf_dir), T.benchmark_paths(spark, sf_dir), 3)


@register(
    """WITH p AS (SELECT item_id AS prompt, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nd}]+') AS q FROM benchmark), d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nd}]+') AS p FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(p))) AS i FROM d), e AS (SELECT doc_id, i, p[i] AS word, p[i + 1] AS next, p[greatest(1, i - 23):i] AS back FROM x JOIN d USING (doc_id)),
    h AS (SELECT prompt, next, list_max(list_filter(range(1, 25), lambda k: k <= len(back) AND k <= len(q) AND back[len(back) - k + 1:] = q[len(q) - k + 1:])) AS n FROM p JOIN e ON e.word = q[len(q)]),
    g AS (SELECT prompt, CAST(n AS INT) AS n, next, count(*) AS times FROM h GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, times DESC, next) AS r FROM g) SELECT prompt, n, next, times FROM r WHERE r = 1"""
)
def follows_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.follows_suffix(T.document_paths(spark, sf_dir), T.benchmark_paths(spark, sf_dir), 24)


@register(
    f"""WITH {_words_sql()}, {_B}, {_grams_sql(2, "w", "g")}, {_grams_sql(2, "b", "q")}, o AS (SELECT d.doc_id AS parent, count(*) OVER (PARTITION BY source) AS occ FROM documents d)
    SELECT segment, next, CAST(sum(occ) AS BIGINT) AS occ, count(DISTINCT g.parent) AS paths FROM g JOIN o ON o.parent = g.parent WHERE next IS NOT NULL AND segment IN (SELECT segment FROM q) GROUP BY segment, next"""
)
def fills_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows each adjacent pair of the benchmark, a document counting as often as its source has documents."""
    occ = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("from")).agg(F.count("*").alias("occ"))
    wanted = phrases.ngrams(T.benchmark_paths(spark, sf_dir), 2).select("segment")
    paths = T.document_paths(spark, sf_dir, "source").join(occ, F.col("source").eqNullSafe(F.col("from")))
    return phrases.fills(paths, None, wanted, 2)


@register(f"WITH {_words_sql()}, n AS (SELECT count(*) AS total FROM documents) SELECT word, count(DISTINCT parent) AS df, count(*) AS occurrences, round(log2((any_value(total) + 1) / (count(DISTINCT parent) + 1)), 6) AS info_bits FROM w, n GROUP BY word")
def salience_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.salience(T.document_paths(spark, sf_dir)).select("word", "df", "occurrences", F.round("info_bits", 6).alias("info_bits"))


@register(
    """WITH p AS MATERIALIZED (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nd}]+') AS p FROM documents),
    d AS MATERIALIZED (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(p)) AS word FROM p) GROUP BY word),
    b AS (SELECT list_transform(range(1, len(p)), lambda i: p[i] || chr(31) || p[i + 1]) AS f, list_transform(range(1, len(p)), lambda i: p[i + 1] || chr(31) || p[i]) AS g FROM p WHERE len(p) > 1),
    k AS (SELECT unnest(list_distinct(list_concat(f, g))) AS k FROM b),
    c AS MATERIALIZED (SELECT split_part(k, chr(31), 1) AS word, split_part(k, chr(31), 2) AS beside, count(*) AS paths FROM k GROUP BY k HAVING count(*) >= 3), n AS (SELECT count(*) AS total FROM documents)
    SELECT c.word, beside, paths, round((paths / x.df) / (y.df / total), 6) AS lift FROM c JOIN d x ON x.word = c.word JOIN d y ON y.word = beside, n WHERE (paths / x.df) / (y.df / total) >= 2.0"""
)
def cooccur_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.lift(T.document_paths(spark, sf_dir), 3, 2.0).select("word", "beside", "paths", F.round("lift", 6).alias("lift"))


@register(
    f"""WITH {_words_sql()}, c AS (SELECT *, CASE WHEN right(sha256(word), 1) = '0' THEN 1 ELSE 0 END AS cut FROM w), k AS (SELECT parent, pos, word, coalesce(sum(cut) OVER (PARTITION BY parent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c)
    SELECT parent, CAST(chunk AS BIGINT) AS chunk, CAST(min(pos) AS INT) AS start, count(*) AS length, substr(sha256(string_agg(word, chr(31) ORDER BY pos)), 1, 32) AS id FROM k GROUP BY parent, chunk"""
)
def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.content_chunks(T.document_paths(spark, sf_dir), 4)


@register(
    f"""WITH {_words_sql()}, f AS (SELECT parent, pos, word, max(CASE WHEN word IN ('the', 'la', 'der') THEN pos END) OVER o AS neg, max(CASE WHEN word IN ('and', 'de', 'und') THEN pos END) OVER o AS stop FROM w WINDOW o AS (PARTITION BY parent ORDER BY pos))
    SELECT parent, count(*) AS words, count(*) FILTER (WHERE neg IS NOT NULL AND coalesce(stop, -1) < neg AND pos - neg <= 3) AS negated FROM f GROUP BY parent"""
)
def polarity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrases.polarity(T.document_paths(spark, sf_dir), ["the", "la", "der"], ["and", "de", "und"], 3)
    return rows.groupBy("parent").agg(F.count("*").alias("words"), F.count_if("negated").alias("negated"))


@register(
    """WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
    g AS (SELECT user_id, event_type, island, count(*) AS run, min(ts) AS t, min(event_id) AS e FROM r GROUP BY 1, 2, 3),
    s AS (SELECT user_id, string_agg(event_type || '*' || run, ' ' ORDER BY t, e) AS path, CAST(sum(run) AS INT) AS length FROM g GROUP BY user_id) SELECT * FROM s"""
)
def runs_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length encoded event types of each user in time order, and the length they expand to."""
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    rows = ev.select("user_id", run_length(F.col("e.event_type")).alias("p"))
    text = F.array_join(F.transform("p", lambda v: F.concat(v["id"], F.lit("*"), v["run"].cast("string"))), " ")
    return rows.select("user_id", text.alias("path"), F.size(expand_runs(F.col("p"))).alias("length"))


@register("SELECT CAST(range AS BIGINT) AS cp, substr(sha256(chr(CAST(range AS INT))), 1, 32) AS id FROM range(0, 1114112) WHERE range NOT BETWEEN 55296 AND 57343")
def codepoint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all code points; surrogates are none."""
    cp = F.col("id")
    high, low = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10), F.lit(0xDC00) + (cp - 0x10000) % 1024
    units = F.when(cp < 0x10000, F.lpad(F.hex(cp), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    text = F.decode(F.unhex(units), "UTF-16BE")
    return spark.range(0, 0x110000).filter("id not between 55296 and 57343").select(cp.alias("cp"), content_id(text).alias("id"))


# ---------------------------------------------------------------- keys, statements, recipes


@register("WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, event_id, round(value, 6) AS value FROM r WHERE k = 1")
def first_declared_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keys.first_declared(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])
    return rows.withColumn("value", F.round("value", 6))


@register("SELECT l.doc_id, l.quality, l.toxic, d.source AS resolved FROM labels l JOIN documents d USING (doc_id)")
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.resolve(table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents"), "doc_id", "source")[0]


@register("SELECT l_partkey, count(*) AS times FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem").select("l_partkey"), table(spark, sf_dir, "part").filter("p_size > 10")
    return keys.resolve(li, "l_partkey", part, "p_partkey", "p_name")[1]


@register("SELECT count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS excluded FROM orders")
def admit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return keys.admit(table(spark, sf_dir, "orders"), ["o_custkey"], good, "c_custkey")[1]


@register(
    """WITH l(list, key, slot) AS (SELECT * FROM (VALUES ('b', 'en', 2), ('a', 'en', 1), ('a', 'fr', 3), ('b', 'de', 5), ('c', 'es', 9)) t(list, key, slot))
    SELECT doc_id, l.list, l.slot FROM documents d LEFT JOIN (SELECT * FROM l WHERE list IN ('a', 'b') AND NOT (list = 'b' AND key IN (SELECT key FROM l WHERE list = 'a'))) l ON l.key = lower(d.lang)"""
)
def type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.createDataFrame([("b", "en", 2), ("a", "en", 1), ("a", "fr", 3), ("b", "de", 5), ("c", "es", 9)], "list string, key string, slot int")
    return keys.typed(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", lists, ["a", "b"]).select("doc_id", "list", "slot")


@register("SELECT event_id, round(greatest(0.0, least(1.0, (value - 10.0) / 90.0)), 6) AS score FROM events")
def score_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.scored(table(spark, sf_dir, "events"), "value", 10, 100).select("event_id", F.round("score", 6).alias("score"))


@register(
    """SELECT CAST(p_partkey AS VARCHAR) AS subject, 'p_brand' AS relation, p_brand AS object FROM part WHERE p_brand <> 'Brand#11' UNION ALL
    SELECT CAST(p_partkey AS VARCHAR), 'p_type', p_type FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_size', CAST(p_size AS VARCHAR) FROM part"""
)
def unpivot_attest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.attest(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type", "p_size"], {"p_brand": "Brand#11"})


@register("SELECT CAST(p_partkey AS VARCHAR) AS subject, unnest(string_split(p_type, ' ')) AS object FROM part")
def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.pair(table(spark, sf_dir, "part").withColumn("kinds", F.split("p_type", " ")), "p_partkey", "kinds")


@register("SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'is' AS relation, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS object FROM orders")
def relate_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("p", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")))
    return keys.relate(rows, "o_orderkey", "is", "p", alone=True)


_PART_RECIPE = """
name parts
names p_partkey p_name p_brand p_type p_size p_retailprice
thing p_partkey
content p_name
attest p_brand
value p_brand as "is made by"
part p_type by " "
pair p_type
when p_size is-not 7
score p_size from 1 to 50
omit p_retailprice
default p_brand Brand#11
"""


@register(
    f"""WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS s, 'is made by' AS p, p_brand AS o, p_size FROM part WHERE p_brand <> 'Brand#11' AND trim(p_brand) <> ''
      UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, unnest(string_split(p_type, ' ')), p_size FROM part WHERE p_size <> 7)
    SELECT {_ID.format("s, p, o")} AS claim, round(greatest(0.0, least(1.0, (p_size - 1) / 49.0)), 6) AS score FROM c WHERE o <> ''"""
)
def recipe_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that a recipe makes of the part table."""
    got = recipes.claims(table(spark, sf_dir, "part"), recipes.parse(_PART_RECIPE))
    return got.select("claim", F.round("score", 6).alias("score"))


@register(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, regexp_extract(line, '^(\\S+) of (\\S+)', 1) AS a, regexp_extract(line, '^(\\S+) of (\\S+)', 2) AS b FROM l WHERE regexp_matches(line, '^(\\S+) of (\\S+)')"""
)
def line_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from lines that fit a pattern."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    pattern = r"^(\S+) of (\S+)"
    return lines.filter(F.col("line").rlike(pattern)).select("doc_id", F.regexp_extract("line", pattern, 1).alias("a"), F.regexp_extract("line", pattern, 2).alias("b"))


@register("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS about FROM pages")
def page_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("about"))


@register("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INT) AS position FROM lineitem")
def together_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("position"))


@register("SELECT l_orderkey AS thing, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def aligned_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of an order's lines as sequences of equal length."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("thing")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("r"))
    return rows.select("thing", F.array_join(F.transform("r.l_partkey", lambda x: x.cast("string")), " ").alias("parts"), F.array_join("r.l_returnflag", " ").alias("flags"))


# ---------------------------------------------------------------- sessions


@register(
    f"""WITH r AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS response, lead(role) OVER w AS answered FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text AS prompt, response, {_ID.format("response, text")} AS claim FROM r WHERE role = 'user' AND answered = 'assistant'"""
)
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.forward import said

    return said(table(spark, sf_dir, "conversations"))


@register("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS prompts, CAST(max(turn) AS BIGINT) AS last FROM conversations GROUP BY conv_id")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("prompts"), F.max("turn").cast("long").alias("last"))


# ---------------------------------------------------------------- graph and geometry


@register(
    f"""WITH RECURSIVE {_rated_sql(_PLACES, "places")}, e AS (SELECT s AS a, o AS b, 0.05 - ln(conf) AS c FROM rated UNION ALL SELECT o, s, 0.05 - ln(conf) FROM rated),
    d AS (SELECT a FROM e GROUP BY a HAVING count(*) <= 4096), f AS (SELECT e.* FROM e JOIN d USING (a)),
    r(origin, node, hops, cost) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0, 0.0::DOUBLE FROM region UNION ALL
      SELECT r.origin, f.b, r.hops + 1, r.cost + f.c FROM r JOIN f ON f.a = r.node WHERE r.hops < 3)
    SELECT origin, node, round(min(cost), 5) AS cost, round(exp(-(min(cost) - 0.05 * arg_min(hops, cost))), 5) AS conf FROM r GROUP BY origin, node"""
)
def degrees_fixed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least chain cost from each region within three hops; nodes of more than 4,096 edges are reached, not crossed."""
    from .plans.forward import edges

    ways = edges(T.rated(T.places(spark, sf_dir)))
    origins = table(spark, sf_dir, "region").select(T.entity("region", "r_regionkey").alias("node"))
    got = graph.degrees(ways, origins, 3, 0.05, 4096)
    return got.select("origin", "node", F.round("cost", 5).alias("cost"), F.round("conf", 5).alias("conf"))


@register(
    f"""WITH {_rated_sql(_PLACES, "places")}, e AS (SELECT s AS a, o AS b, conf FROM rated UNION ALL SELECT o, s, conf FROM rated), c AS (SELECT 'region:' || r_regionkey AS node, 1.0::DOUBLE AS force FROM region),
    p AS (SELECT b AS node, sum(conf * force / n) AS force FROM (SELECT e.*, c.force, count(*) OVER (PARTITION BY a) AS n FROM e JOIN c ON c.node = e.a) GROUP BY b)
    SELECT node, round(sum(force), 6) AS force FROM (SELECT * FROM c UNION ALL SELECT * FROM p) GROUP BY node"""
)
def layer_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.forward import edges

    cells = table(spark, sf_dir, "region").select(T.entity("region", "r_regionkey").alias("node"), F.lit(1.0).alias("force"))
    return graph.layer(edges(T.rated(T.places(spark, sf_dir))), cells, 64).withColumn("force", F.round("force", 6))


@register(None)
def walk_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random walks with restart from each nation; draws are hashes, so every run gives the same visits."""
    from .plans.forward import edges

    origins = table(spark, sf_dir, "nation").select(T.entity("nation", "n_nationkey").alias("node"))
    return graph.walks(edges(T.rated(T.places(spark, sf_dir))), origins, 16, 4, 0.25, "seed", 100_000)


@register(
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT unnest(range(1, 65)) AS i),
    d AS (SELECT q.query, v.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.e, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS dist FROM q JOIN embeddings v ON v.vec_id <> q.query),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, id) AS rank FROM d) SELECT query, id, round(dist, 5) AS dist, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""
)
def knn_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return shape.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10).withColumn("dist", F.round("dist", 5))


@register("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INT) AS dim, round(avg(v), 5) AS mean FROM x GROUP BY label, dim")
def centroid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.centroids(table(spark, sf_dir, "embeddings"), "label").withColumn("mean", F.round("mean", 5))


@register(None)
def shape_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-warping distance between each vector's trajectory of four 16-wide points and the next one's."""
    v = table(spark, sf_dir, "embeddings")
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")))
    rows = v.select("vec_id", points.alias("p"))
    pairs = rows.select(F.col("vec_id").alias("a_id"), F.col("p").alias("a")).join(rows.select(F.col("vec_id").alias("b_id"), F.col("p").alias("b")), F.col("b_id") == F.col("a_id") + 1)
    return shape.trajectory_distances(pairs, "dtw").withColumn("distance", F.round("distance", 6))


@register(
    f"""WITH v AS (SELECT 'user:' || user_id AS s, event_type AS o, value FROM events), c AS (SELECT {_ID.format("s, o")} AS claim, least(1.0, greatest(0.0, value / 100.0)) AS score FROM v)
    SELECT claim, 'log' AS witness, 'log' AS lineage, count(*) AS games, count(*) AS tokens, round(sum(score), 5) AS wins FROM c GROUP BY claim"""
)
def streamed_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of events that arrive as a stream of files, folded from the log of micro-batches."""
    from .functions.core import rescale
    from .streaming import ingest

    import uuid

    place = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"

    def observe(batch: DataFrame) -> DataFrame:
        parts = F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.col("event_type"))
        return batch.select(content_id_of(parts).alias("claim"), F.lit("log").alias("witness"), F.lit("log").alias("lineage"), F.col("event_id").alias("record"), rescale(F.col("value"), 0, 100).alias("score"), F.lit(1).alias("run"), F.lit(False).alias("games"), F.lit(0).alias("position"))

    schema = table(spark, sf_dir, "events").schema
    ingest.ingest(spark, f"{sf_dir}/events*.parquet", schema, observe, f"{place}/log", f"{place}/state")
    rows = ingest.tallies(spark, f"{place}/log")
    return rows.select("claim", "witness", "lineage", "games", "tokens", F.round("wins", 5).alias("wins"))



# ---------------------------------------------------------------- more planes of the forward pass, identity, windows


@register(
    """WITH l AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
    w AS (SELECT doc_id, k, regexp_extract_all(lower(line), '[\\p{L}\\p{Nd}]+') AS ws FROM l),
    i AS (SELECT doc_id, k, CASE WHEN len(ws) = 1 THEN ws[1] ELSE substr(sha256(array_to_string(ws, chr(31))), 1, 32) END AS id FROM w WHERE len(ws) > 0)
    SELECT doc_id, count(*) AS lines, CASE WHEN count(*) = 1 THEN min(id) ELSE substr(sha256(string_agg(id, chr(31) ORDER BY k)), 1, 32) END AS id FROM i GROUP BY doc_id"""
)
def composition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle ids: a line of its words, a document of its lines; one child is that child."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{Nd}]+)"), 1))
    ids = F.transform(F.filter(lines, lambda w: F.size(w) > 0), content_id_of)
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("c")).filter(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("lines"), content_id_of("c").alias("id"))


@register(f"WITH {_words_sql()}, {_B} SELECT DISTINCT word AS id FROM b WHERE word NOT IN (SELECT word FROM w)")
def presence_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that the documents do not hold yet: what an ingest would add."""
    have = _document_words(spark, sf_dir).select(F.col("child").alias("id"))
    return K.explode_paths(T.benchmark_paths(spark, sf_dir)).select(F.col("child").alias("id")).distinct().join(have, "id", "left_anti")


@register(f"WITH {_words_sql()}, {_B}, s AS (SELECT parent, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM b WINDOW o AS (PARTITION BY parent ORDER BY pos)) SELECT parent, count(*) AS spans, count(DISTINCT a || ' ' || b || ' ' || c) AS kinds FROM s WHERE c IS NOT NULL GROUP BY parent")
def span_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = phrases.ngrams(T.benchmark_paths(spark, sf_dir), 3)
    return grams.groupBy("parent").agg(F.count("*").alias("spans"), F.count_distinct("segment").alias("kinds"))


@register(
    f"""WITH {_words_sql()}, {_B}, e AS (SELECT parent, max(pos) AS last FROM w GROUP BY parent), k AS (SELECT DISTINCT word FROM b WHERE pos = 0),
    h AS (SELECT w.word AS child, w.parent FROM w JOIN e USING (parent) WHERE w.pos IN (0, e.last)) SELECT child, count(DISTINCT parent) AS parents FROM h JOIN k ON k.word = child GROUP BY child"""
)
def endpoint_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that open or close with a word some benchmark item opens with."""
    ends = K.endpoints(T.document_paths(spark, sf_dir)).select("parent", F.explode(F.array("first", "last")).alias("child"))
    wanted = K.endpoints(T.benchmark_paths(spark, sf_dir)).select(F.col("first").alias("child")).distinct()
    return ends.join(wanted, "child", "left_semi").groupBy("child").agg(F.count_distinct("parent").alias("parents"))


@register(
    f"""WITH {_rated_sql(_PLACES, "places")}, e AS (SELECT s AS a, o AS b, conf FROM rated UNION ALL SELECT o, s, conf FROM rated), q AS (SELECT 'region:' || n_regionkey AS prompt, 'nation:' || n_nationkey AS word FROM nation),
    g AS (SELECT prompt, b AS node, round(sum(conf), 9) AS force, count(DISTINCT word) AS support FROM q JOIN e ON a = word GROUP BY prompt, b), f AS (SELECT g.* FROM g LEFT JOIN q ON q.prompt = g.prompt AND q.word = g.node WHERE q.word IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY force DESC, node) AS rank FROM f) SELECT prompt, node, round(force, 6) AS force, support, CAST(rank AS INT) AS rank FROM r WHERE rank <= 12"""
)
def pulled_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a region's nations pull: other ends of their claims by summed confidence, the first twelve."""
    from .plans import firmware, forward

    obs = T.places(spark, sf_dir)
    known = forward.Knowledge(T.claim_table(obs), fold.tally(obs))
    prompts = table(spark, sf_dir, "nation").select(T.entity("region", "n_regionkey").alias("prompt"), T.entity("nation", "n_nationkey").alias("word"))
    return forward.pulled(known, prompts, firmware.Firmware(), 12).withColumn("force", F.round("force", 6))


@register(
    """WITH p AS (SELECT user_id, event_type AS node, count(*) AS agree, round(max(value), 6) AS confidence FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY agree DESC, confidence DESC, node) AS k FROM p)
    SELECT user_id, node, agree, confidence FROM r WHERE k = 1"""
)
def elect_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("node")).agg(F.count("*").alias("agree"), F.round(F.max("value"), 6).alias("confidence"))
    return graph.elect(rows, "user_id", ["agree", "confidence"])


@register(
    f"""WITH o AS (SELECT {_ID.format("'user:' || user_id, event_type")} AS claim, event_type AS witness, event_id % 3 AS batch FROM events), n AS (SELECT *, max(batch) OVER (PARTITION BY witness) AS newest FROM o)
    SELECT claim, witness, count(*) AS games FROM n WHERE batch = newest GROUP BY claim, witness"""
)
def superseded_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the newest reading of each witness counts."""
    from .streaming.ingest import current

    ev = table(spark, sf_dir, "events")
    log = ev.select(content_id(F.concat(F.lit("user:"), F.col("user_id").cast("string")), "event_type").alias("claim"), F.col("event_type").alias("witness"), (F.col("event_id") % 3).alias("batch"))
    return current(log).groupBy("claim", "witness").agg(F.count("*").alias("games"))


@register(
    f"""WITH RECURSIVE {_EDGES}, k AS (SELECT 'customer:' || c_custkey AS key, c_custkey % 8 AS bit FROM customer), up(bit, node) AS (SELECT bit, key FROM k UNION SELECT u.bit, e.parent FROM up u JOIN edges e ON e.child = u.node)
    SELECT node, CAST(bit_or(CAST(1 AS BIGINT) << CAST(bit AS INT)) AS BIGINT) AS keys FROM up GROUP BY node"""
)
def closure_keymask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of eight groups of customers reach each node, as bits."""
    edges = _place_edges(spark, sf_dir)
    marks = table(spark, sf_dir, "customer").select(T.entity("customer", "c_custkey").alias("key"), (F.col("c_custkey") % 8).cast("int").alias("bit"))
    # the bit is the key of the closure: a group goes up once, however many customers it has
    first = edges.join(marks, edges.child == marks.key).select(F.col("bit").cast("string").alias("key"), F.col("parent").alias("node")).distinct()
    linked = first.select(F.col("key").alias("child"), F.col("node").alias("parent")).unionByName(edges.filter("child not like 'customer:%' and child not like 'supplier:%'"))
    up = K.closure(linked, first.select("key").distinct()).filter("node <> key").select("node", F.col("key").cast("int").alias("bit"))
    both = up.unionByName(marks.select(F.col("key").alias("node"), "bit"))
    return both.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("keys"))


@register("SELECT 'p_retailprice' AS field, count(p_retailprice) AS rows FROM part UNION ALL SELECT 'extra', count(*) FROM part")
def unread_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields the recipe does not mention, counted."""
    rows = table(spark, sf_dir, "part").withColumn("extra", F.lit("x"))
    return recipes.obligations(rows, recipes.parse(_PART_RECIPE.replace("omit p_retailprice", "")))


@register(
    f"""WITH {_words_sql()}, {_grams_sql(1, "w", "g")} SELECT segment AS word, next AS beside, count(DISTINCT parent) AS paths FROM g WHERE next IS NOT NULL AND segment < next GROUP BY 1, 2"""
)
def role_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent pairs in alphabetical order and the paths that hold them in that order."""
    grams = phrases.ngrams(T.document_paths(spark, sf_dir), 1).filter("next is not null and segment < next")
    return grams.groupBy(F.col("segment").alias("word"), F.col("next").alias("beside")).agg(F.count_distinct("parent").alias("paths"))


@register(
    f"""WITH {_SUPPLY}, {_tally_sql("supply")}, {_standing_sql()}, p AS (SELECT s AS src, claim, conf FROM standing JOIN (SELECT DISTINCT claim, s FROM supply) USING (claim)), m AS (SELECT src, max(conf) AS best FROM p GROUP BY src)
    SELECT src, count(*) AS near FROM p JOIN m USING (src) WHERE conf >= best * 0.8 GROUP BY src"""
)
def top_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims of each part stand within a fifth of its best."""
    rows = T.rated(T.supply(spark, sf_dir), by_subject=True).select(F.col("subject").alias("src"), "conf")
    best = F.max("conf").over(Window.partitionBy("src"))
    return rows.withColumn("best", best).filter("conf >= best * cast(0.8 as double)").groupBy("src").agg(F.count("*").alias("near"))


# ---------------------------------------------------------------- vocabularies and coordinates


@register(
    """WITH a AS (SELECT DISTINCT p_brand AS list, p_type AS key FROM part WHERE p_partkey % 2 = 0), f AS (SELECT list, key, row_number() OVER (PARTITION BY list ORDER BY key) - 1 AS slot FROM a),
    n AS (SELECT DISTINCT p_brand AS list, p_type AS key FROM part EXCEPT SELECT list, key FROM f), m AS (SELECT list, max(slot) AS last FROM f GROUP BY list)
    SELECT list, key, CAST(slot AS BIGINT) AS slot FROM f UNION ALL SELECT n.list, key, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY n.list ORDER BY key) AS BIGINT) FROM n LEFT JOIN m ON m.list = n.list"""
)
def vocabulary_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the types of each brand: frozen for one half of the parts, then grown by the other."""
    from .operators import vocabulary

    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("list"), F.col("p_type").alias("key"), "p_partkey")
    frozen = vocabulary.freeze(part.filter("p_partkey % 2 = 0"))
    return vocabulary.freeze(part, frozen).withColumn("slot", F.col("slot").cast("long"))


@register("SELECT p_partkey, CAST((p_size & 63) | ((length(p_brand) & 15) << 6) | ((length(p_type) & 31) << 10) AS BIGINT) AS mask, CAST(length(p_brand) & 15 AS BIGINT) AS brand FROM part")
def bank_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import vocabulary

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.length("p_brand").alias("b"), F.length("p_type").alias("t"))
    packed = vocabulary.pack_banks(rows, {"p_size": (0, 6), "b": (6, 4), "t": (10, 5)})
    return packed.select("p_partkey", "mask", vocabulary.unpack_bank("mask", 6, 4).alias("brand"))


@register(
    """WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS m, 1 + vec_id % 3 AS run FROM embeddings)
    SELECT CAST(label AS VARCHAR) AS id, round(sum(x * run) / sum(run), 6) AS x, round(sum(y * run) / sum(run), 6) AS y, round(sum(z * run) / sum(run), 6) AS z, round(sum(m * run) / sum(run), 6) AS m FROM p GROUP BY label"""
)
def mean_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of labels as compositions of their vectors, a vector running once to three times."""
    from .operators import coordinates

    v = table(spark, sf_dir, "embeddings")
    known = v.select(F.col("vec_id").cast("string").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate(coordinates.AXES)])
    held = v.select(F.col("vec_id").cast("string").alias("child"), F.col("label").cast("string").alias("parent"), (1 + F.col("vec_id") % 3).alias("run"))
    got = coordinates.mean_coordinates(held, known)
    return got.select("id", *[F.round(a, 6).alias(a) for a in coordinates.AXES])
