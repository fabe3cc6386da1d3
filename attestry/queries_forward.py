"""Registered queries of the evidence planes and of field values, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import values as V
from .functions.core import content_id, content_id_of
from .operators import claims as C
from .operators import fold, graph, keys, phrases, planes
from .operators import containment as K
from .plans import firmware, forward
from .plans import tables as T
from .plans.tables import table
from .queries import _DOCS, _ID, _PLACES, _SUPPLY, _grams_sql, _rated_sql, _tally_sql, _words_sql, register
from .sources import readers

_ITEMS = _words_sql("benchmark", "item_id", "b")


# ---------------------------------------------------------------- planes


@register(
    f"""WITH {_words_sql()}, {_ITEMS}, n AS (SELECT count(*) AS total FROM documents), s AS (SELECT word, log2((any_value(total) + 1) / (count(DISTINCT parent) + 1)) AS info FROM w, n GROUP BY word),
    r AS (SELECT parent AS prompt, word, coalesce(info / nullif(max(info) OVER (PARTITION BY parent), 0), 0.0) AS s FROM (SELECT DISTINCT parent, word FROM b) LEFT JOIN s USING (word))
    SELECT prompt, word, round(CASE WHEN s >= 0.5 THEN 0.75 + 0.25 * s ELSE 0.5 * (0.2 + 0.8 * s) END, 6) AS pull FROM r"""
)
def role_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each word of each benchmark item pulls, by its salience among the documents."""
    words = K.explode_paths(T.benchmark_paths(spark, sf_dir)).select(F.col("parent").alias("prompt"), F.col("child").alias("word"))
    return planes.role_pull(words, phrases.salience(T.document_paths(spark, sf_dir))).withColumn("pull", F.round("pull", 6))


@register(
    f"""WITH {_PLACES}, e AS (SELECT DISTINCT s AS a, o AS b FROM places UNION SELECT o, s FROM places),
    p AS (SELECT 'region:' || n_regionkey AS prompt, 'nation:' || n_nationkey AS word, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
    SELECT prompt, b AS node, bit_or(1::BIGINT << CAST(i AS INT)) AS bits0, 0::BIGINT AS bits1, 0::BIGINT AS bits2, 0::BIGINT AS bits3 FROM p JOIN e ON a = word GROUP BY prompt, b"""
)
def support_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations of a region lead to each entity, as bits."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    prompts = table(spark, sf_dir, "nation").select(T.entity("region", "n_regionkey").alias("prompt"), place.alias("ordinal"), T.entity("nation", "n_nationkey").alias("word"))
    ends = T.claim_table(T.places(spark, sf_dir)).withColumn("conf", F.lit(1.0))
    return planes.support_bits(prompts, forward.edges(ends).select("a", "b").distinct())


@register(
    """WITH l AS (SELECT p_name AS lemma, p_type AS concept, count(*) AS uses FROM part GROUP BY 1, 2)
    SELECT lemma, concept, round(ln((uses + 1) / (sum(uses) OVER (PARTITION BY lemma) + count(*) OVER (PARTITION BY lemma))), 6) AS prior FROM l"""
)
def sense_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("lemma"), F.col("p_type").alias("concept")).agg(F.count("*").alias("uses")).withColumn("rank", F.lit(1))
    return planes.sense_priors(lex).withColumn("prior", F.round("prior", 6))


@register(
    f"""WITH {_words_sql()}, o AS (SELECT doc_id AS parent, quality = 1 AS won FROM labels), n AS (SELECT count(*) FILTER (WHERE NOT won) AS nl, count(*) FILTER (WHERE won) AS nw FROM o),
    h AS (SELECT DISTINCT parent, word FROM w), p AS (SELECT word, count(*) FILTER (WHERE NOT won) AS lost, count(*) FILTER (WHERE won) AS won FROM h JOIN o USING (parent) GROUP BY word)
    SELECT word, lost, won, round(coalesce(lost / nullif(nl, 0), 0) - coalesce(won / nullif(nw, 0), 0), 6) AS contrast FROM p, n"""
)
def loss_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much oftener each word stands in documents marked bad than in those marked good."""
    words = K.explode_paths(T.document_paths(spark, sf_dir)).select("parent", F.col("child").alias("word"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("parent"), (F.col("quality") == 1).alias("won"))
    return planes.loss_contrast(words, outcomes).withColumn("contrast", F.round("contrast", 6))


@register(
    f"""WITH {_words_sql()}, h AS (SELECT DISTINCT parent, word FROM w), v AS (SELECT word, lang, count(*) AS votes FROM h JOIN documents ON doc_id = parent GROUP BY 1, 2),
    m AS (SELECT *, max(votes) OVER (PARTITION BY word) AS top FROM v) SELECT word, min(lang) AS lang, max(votes) AS votes FROM m WHERE votes = top GROUP BY word HAVING count(*) = 1"""
)
def voted_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language most documents that hold a word are in; two equal leaders give none."""
    held = T.document_paths(spark, sf_dir, "lang").select("lang", F.explode(F.array_distinct("path")).alias("word"))  # a word once a document, with its language
    return fold.majority(held, "word", "lang").select("word", "lang", "votes")


@register(
    f"""WITH {_rated_sql(_SUPPLY, "supply")}, u AS (SELECT claim, sum(games) AS uses, min(position) AS position FROM tally GROUP BY claim),
    r AS (SELECT s AS src, claim, uses, row_number() OVER (PARTITION BY s ORDER BY uses DESC, position ASC NULLS LAST, conf DESC, claim) AS rank FROM rated JOIN u USING (claim))
    SELECT src, claim, CAST(uses AS BIGINT) AS uses, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8"""
)
def usage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rated(T.supply(spark, sf_dir), by_subject=True).select(F.col("subject").alias("src"), "claim", F.col("matches").alias("uses"), "position", "conf")
    return planes.by_usage(rows, None, ["src"], 8).select("src", "claim", "uses", "rank")


@register(
    f"""WITH {_words_sql()}, {_ITEMS}, {_grams_sql(2, "w", "g")}, {_grams_sql(2, "b", "q")}, c AS (SELECT segment, next, count(*) AS times FROM g WHERE segment IN (SELECT segment FROM q) GROUP BY 1, 2),
    t AS (SELECT *, coalesce(sum(times) FILTER (WHERE next IS NULL) OVER (PARTITION BY segment), 0) AS ended, sum(times) OVER (PARTITION BY segment) AS n FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY times DESC, next) AS k FROM t WHERE next IS NOT NULL)
    SELECT segment, next, times, CAST(n - ended AS BIGINT) AS "on", CAST(ended AS BIGINT) AS ended FROM r WHERE k = 1 AND times >= 2 AND n - ended >= ended"""
)
def segment_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuation most documents give each pair of words of the benchmark."""
    return planes.take_segment(T.document_paths(spark, sf_dir), phrases.ngrams(T.benchmark_paths(spark, sf_dir), 2), 2)


@register(
    f"""WITH {_PLACES}, c AS (SELECT DISTINCT claim, s, p, o FROM places), e AS (SELECT claim, p, s AS hub FROM c UNION SELECT claim, p, o FROM c),
    a AS (SELECT claim, hub AS part FROM e UNION SELECT claim, p FROM c), n AS (SELECT part AS hub FROM a GROUP BY part HAVING count(DISTINCT claim) > 40)
    SELECT hub, p AS relation, claim FROM e JOIN n USING (hub) WHERE p = 'region' AND hub <> p"""
)
def hubs_upward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of more than 40 claims, read again with the relation that leads up."""
    return planes.upward(T.claim_table(T.places(spark, sf_dir)), ["region"], 40)


@register(
    f"""WITH {_rated_sql(_PLACES, "places")}, e AS (SELECT s AS a, o AS b, conf FROM rated UNION ALL SELECT o, s, conf FROM rated), q AS (SELECT 'region:' || n_regionkey AS prompt, 'nation:' || n_nationkey AS word FROM nation),
    g AS (SELECT prompt, b AS node, round(sum(conf), 9) AS force, count(DISTINCT word) AS support FROM q JOIN e ON a = word GROUP BY prompt, b), f AS (SELECT g.* FROM g LEFT JOIN q ON q.prompt = g.prompt AND q.word = g.node WHERE q.word IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY support DESC, force DESC, node) AS k FROM f) SELECT prompt, node, CAST(support AS DOUBLE) AS agree, round(force, 6) AS confidence FROM r WHERE k = 1"""
)
def turn_elected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole turn for each region: its nations as the prompt, walks left out, one entity elected."""
    obs = T.places(spark, sf_dir)
    known = forward.Knowledge(T.claim_table(obs), fold.tally(obs))
    prompts = table(spark, sf_dir, "nation").groupBy(T.entity("region", "n_regionkey").alias("prompt")).agg(F.collect_list(T.entity("nation", "n_nationkey")).alias("path"))
    got = forward.turn(known, prompts, firmware.Firmware(walks=0, nearest=1_000_000))
    return got.select("prompt", "node", "agree", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- lists of ids, records, turns


@register(
    f"""WITH {_words_sql()}, {_ITEMS}, a AS (SELECT word, count(DISTINCT parent) AS holders, count(*) AS occurrences FROM w GROUP BY word)
    SELECT parent AS set_id, CAST(pos AS INT) AS ordinal, word, holders, occurrences FROM b LEFT JOIN a USING (word)"""
)
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the words of each benchmark item, in its order and with its repeats; unknown words stay."""
    known = K.holder_counts(K.explode_paths(T.document_paths(spark, sf_dir))).withColumnRenamed("child", "word")
    asked = T.benchmark_paths(spark, sf_dir).select(F.col("parent").alias("set_id"), F.col("path").alias("keys"))
    return planes.in_order(asked, known, "word")


@register(
    f"""WITH {_SUPPLY}, r AS (SELECT record, count(*) AS n, min(claim) AS one, substr(sha256(string_agg(claim, chr(31) ORDER BY position, claim)), 1, 32) AS many FROM supply GROUP BY record)
    SELECT record, n, CASE WHEN n = 1 THEN one ELSE many END AS record_id FROM r"""
)
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: the claims of their lines in order."""
    return planes.records(T.supply(spark, sf_dir).select("record", "position", "claim"), "record", ["position"], content_id_of)


@register(
    f"""WITH t AS (SELECT conv_id, turn, {_ID.format("role, coalesce(text, '')")} AS claim FROM conversations), f AS (SELECT conv_id, claim, min(turn) AS turn FROM t GROUP BY 1, 2)
    SELECT conv_id, turn, claim, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, claim) AS INT) AS place FROM f"""
)
def turns_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation read twice: what was said is recorded once, in its first place."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", content_id(F.col("role"), F.coalesce("text", F.lit(""))).alias("claim"))
    return planes.said_once(t.unionByName(t), "conv_id", ["turn"])


@register(f"WITH {_SUPPLY} SELECT claim, lineage AS qualifier, count(*) AS run FROM supply GROUP BY claim, lineage")
def qualified_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same claim under another qualifier is another event."""
    return T.supply(spark, sf_dir).groupBy("claim", F.col("lineage").alias("qualifier")).agg(F.count("*").alias("run"))


@register(f"WITH {_rated_sql(_DOCS, 'aboutdocs')} SELECT claim, round(conf, 6) AS conf FROM rated WHERE p IN ('language', 'quality')")
def only_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.only_predicates(T.rated(T.about_documents(spark, sf_dir)), ["language", "quality"])
    return rows.select("claim", F.round("conf", 6).alias("conf"))


@register(
    f"""WITH {_DOCS}, {_tally_sql("aboutdocs")}, f AS (SELECT DISTINCT claim FROM aboutdocs JOIN documents ON doc_id = record WHERE lang = 'fr')
    SELECT claim, witness, games, tokens, round(wins, 6) AS wins FROM tally SEMI JOIN f USING (claim)"""
)
def attested_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testimony of the claims that some French document is about."""
    obs = T.about_documents(spark, sf_dir)
    files = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("record"))
    held = obs.join(files, "record", "left_semi").select("claim").distinct()
    return fold.tally(obs).join(held, "claim", "left_semi").select("claim", "witness", "games", "tokens", F.round("wins", 6).alias("wins"))


# ---------------------------------------------------------------- values and statements


@register(
    """SELECT o_orderkey, 'priority ' || regexp_extract(o_orderpriority, '^(\\d)-(.*)$', 1) || ': ' || regexp_extract(o_orderpriority, '^(\\d)-(.*)$', 2) AS label,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, (['urgent', 'high', 'medium', 'none', 'low'])[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS item,
    replace(o_orderpriority, '-', ' ') AS written, substr(o_orderpriority, 1, 3) AS head FROM orders"""
)
def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities through a template, as a number, as an item of a list, with spaces for its mark and as a span."""
    p = F.col("o_orderpriority")
    level = V.radix(V.templated(p, [(r"(\d)-.*", r"\1")]), 10)
    names = F.array(*[F.lit(x) for x in ("urgent", "high", "medium", "none", "low")])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", V.templated(p, [(r"(\d)-(.*)", r"priority \1: \2"), (r".*", "other")]).alias("label"), level.alias("level"), V.item(names, level.cast("int"), 1).alias("item"),
        V.spaced(p, "-").alias("written"), V.span(p, F.lit(0), F.lit(2), inclusive=True).alias("head"),
    )


@register(
    """SELECT CAST(p_partkey AS VARCHAR) AS subject, 'p_name' AS relation, p_name AS object FROM part WHERE p_name <> '' UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_type', p_type FROM part WHERE p_type NOT IN ('', 'ECONOMY')
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_size <> 1"""
)
def default_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of parts as claims; a field at its default says nothing."""
    return keys.attest(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type", "p_size"], {"p_type": "ECONOMY", "p_size": "1"})


@register(
    """SELECT 'doc ' || doc_id AS subject, 'is' AS relation, 'toxic' AS object, CAST(toxic AS DOUBLE) AS score FROM labels
    UNION ALL SELECT 'doc ' || doc_id, 'is' || chr(9) || 'so', NULL, 1.0 FROM labels"""
)
def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as statement lines, with an escaped tab and with parts left out, and read back."""
    lab = table(spark, sf_dir, "labels")
    doc = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    one = lab.select(F.concat_ws("\t", doc, F.lit("is"), F.lit("toxic"), F.col("toxic").cast("string")).alias("value"))
    two = lab.select(F.concat_ws("\t", doc, F.lit("is\\\tso")).alias("value"))
    return readers.statements(one.unionByName(two))


@register("SELECT CAST(event_id AS VARCHAR) AS subject, 'k' AS relation, json_extract_string(props, '$.k') AS object FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the objects in a cell as claims; null says nothing."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("subject"), F.explode(F.from_json("props", "map<string,string>")).alias("relation", "object"))
    return rows.filter("object is not null")


@register("SELECT 'item ' || item_id AS title, CAST(NULL AS VARCHAR) AS author, 'en' AS language, trim(text) AS body FROM benchmark")
def book_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items bound as project books; header fields and the body between the marks come back."""
    head = F.concat(F.lit("Title: item "), F.col("item_id").cast("string"), F.lit("\nLanguage: en\n\n*** START OF THIS PROJECT BOOK ***\n"))
    return readers.book(table(spark, sf_dir, "benchmark").select(F.concat(head, "text", F.lit("\n\n*** END OF THIS PROJECT BOOK ***\nlicence")).alias("value")))


@register(
    f"""WITH {_rated_sql(_SUPPLY, "supply")}, r AS (SELECT s AS src, claim, conf, row_number() OVER (PARTITION BY s ORDER BY conf DESC, claim) AS k, max(conf) OVER (PARTITION BY s) AS best FROM rated),
    t AS (SELECT src, claim, row_number() OVER (PARTITION BY src ORDER BY substr(sha256('seed' || chr(31) || src || chr(31) || claim), 1, 13), claim) AS d FROM r WHERE conf >= best * 0.8)
    SELECT src, claim FROM t WHERE d = 1"""
)
def top_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part's claims within a fifth of its best, one drawn by the hash of seed, part and claim."""
    rows = T.rated(T.supply(spark, sf_dir), by_subject=True).select(F.col("subject").alias("src"), "claim", "conf")
    return graph.draw_within(rows, "src", "claim", "conf", 0.2, "seed")
