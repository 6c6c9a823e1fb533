"""Queries of the training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.text import folded, terms, trimmed
from claimgraph.llm import bpe, names, ngrams, packing, quality, topn
from claimgraph.plans.dealt import _RECORDS
from claimgraph.sources import records, table

LONGEST_TERM = 90
VOCABULARY = bpe.DEFAULT_VOCABULARY
CONTAINER_TOKENS = 2048
NAME_KEYS = ("advisor", "authored_by", "contributor", "corporate_author")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record (type and id as one text), key (folded) and terms (folded, of allowed length) of each claim."""
    rows = records(table(spark, sf_dir, "enliterator_claims"), "tendable_type", "tendable_id", "key", "value")
    record = F.to_json(F.array("tendable_type", "tendable_id"))
    held = F.filter(F.transform(terms(F.col("value")), folded), lambda t: F.length(t).between(1, LONGEST_TERM))
    return rows.select(record.alias("record"), folded(F.col("key")).alias("key"), held.alias("terms"))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of up to two symbols of the claims; a claim's sequence is its key and its terms, marked by field."""
    claims = _claims(spark, sf_dir)
    sequence = F.concat(F.array(F.concat(F.lit("k"), "key")), F.transform("terms", lambda t: F.concat(F.lit("v"), t)))
    counts = ngrams.ngram_counts(claims.select("record", sequence.alias("sequence")), "sequence", "record", sigma=2)
    total = claims.select("record").distinct().agg(F.count("*").alias("n"))
    return ngrams.marked(counts, total)


def _field(symbol: str):
    return F.when(F.substring(symbol, 1, 1) == "k", F.lit("key")).otherwise(F.lit("value"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and terms that are too rare or too common to serve as headings."""
    single = _headings(spark, sf_dir).where("s1 IS NULL AND mark IS NOT NULL")
    return single.select(_field("s0").alias("field"), F.expr("substring(s0, 2)").alias("term"), "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key, term and adjacent pair of them with its occurrences, records and mark."""
    found = _headings(spark, sf_dir)
    return found.select(_field("s0").alias("field"), F.expr("substring(s0, 2)").alias("term"), F.expr("substring(s1, 2)").alias("following"), "occurrences", "records", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest visits of each tendable record and facet that has more."""
    keys = ["tendable_type", "tendable_id", "facet"]
    visits = records(table(spark, sf_dir, "enliterator_visits"), *keys, "started_at")
    held = visits.where("started_at IS NOT NULL").select(*keys, "started_at", "id")
    latest = topn.top_n(held, keys, [F.col("started_at").desc(), F.col("id").desc()], n=3, over=3)
    return latest.select(*keys, F.col("id").alias("visit_id"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct name of the name claims and the entity it stands for."""
    claims = records(table(spark, sf_dir, "enliterator_claims"), "key", "value")
    held = claims.where(folded(F.col("key")).isin(*NAME_KEYS)).select(F.explode(terms(F.col("value"))).alias("name"))
    counted = held.groupBy(trimmed(F.col("name")).alias("name")).agg(F.count("*").alias("n"))
    return names.link(counted.where("name <> ''"), "name", "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    return names.pairs(_linked(spark, sf_dir))


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with the first spelling of its entity and the number of its spellings; null where it stands for none or several."""
    linked = _linked(spark, sf_dir)
    sizes = linked.where("entity IS NOT NULL").groupBy("entity").agg(F.min("name").alias("representative"), F.count("*").alias("spellings"))
    return linked.join(sizes, "entity", "left").select("name", "representative", "spellings")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces (only texts over the capacity have several) and their reading containers."""
    sized = bpe.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)
    packed = packing.pack(sized, "doc_id", "tokens", CONTAINER_TOKENS)
    return packed.select("doc_id", "piece", F.col("start").alias("first_token"), F.col("size").alias("tokens"), F.col("bin").alias("container"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: documents, and the numbers of overfull containers, of documents cut though they fit, and of documents whose pieces are not one after the other."""
    rows = p7_containers(spark, sf_dir)
    loads = rows.groupBy("container").agg(F.sum("tokens").alias("load"))
    whole = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("upto"), F.count_distinct("first_token").alias("starts"))
    one = lambda name, frame: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    cut = whole.where((F.col("pieces") > 1) & (F.col("tokens") <= CONTAINER_TOKENS))
    torn = whole.where("upto <> tokens OR starts <> pieces")
    parts = [one("documents", whole), one("overfull", loads.where(F.col("load") > CONTAINER_TOKENS)), one("cut_though_fitting", cut), one("torn", torn)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and form."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(documents, table(spark, sf_dir, "document_labels"), "doc_id", "text", "form")
    return quality.statistics(documents, "doc_id", "text", rules)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents most of whose characters stand in lists, tables or junk: those to which `p8_statistics` gives one of these forms."""
    return p8_statistics(spark, sf_dir).where("form NOT IN ('prose', 'blank')").select("doc_id")


_FOLD = "lower(trim(regexp_replace({0}, '[ \\t\\n' || chr(160) || ']+', ' ', 'g')))"
_TERMS = f"""
WITH c AS MATERIALIZED (SELECT id, to_json([tendable_type, tendable_id]) AS record, {_FOLD.format("key")} AS key, value::JSON AS v FROM {_RECORDS.format("enliterator_claims")}),
i AS (SELECT id, record, key, 1 AS pos, v AS item FROM c WHERE json_type(v) <> 'ARRAY'
  UNION ALL SELECT id, record, key, unnest(range(1, 1 + json_array_length(v)::BIGINT)), unnest(json_extract(v, '$[*]')) FROM c WHERE json_type(v) = 'ARRAY'),
t AS (SELECT id, record, key, pos, CASE json_type(item) WHEN 'VARCHAR' THEN item->>'$'
    WHEN 'OBJECT' THEN CASE WHEN json_type(coalesce(item->'$.designation', item->'$.name')) = 'VARCHAR' THEN coalesce(item->>'$.designation', item->>'$.name') END END AS raw FROM i),
f AS (SELECT id, record, key, pos, {_FOLD.format("raw")} AS term FROM t WHERE raw IS NOT NULL),
s AS (SELECT id, record, 0 AS pos, 'key' AS field, key AS term FROM c WHERE key IS NOT NULL
  UNION ALL SELECT id, record, pos, 'value', term FROM f WHERE length(term) BETWEEN 1 AND 90),
m AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM s GROUP BY 1, 2),
n AS (SELECT count(DISTINCT record) AS total FROM c)
"""
_MARK = "CASE WHEN records = 1 THEN 'rare' WHEN records * 20 >= (SELECT total FROM n) THEN 'common' END"

SQL = {
    "p1_found": _TERMS + f"SELECT field, term, {_MARK} AS mark FROM m WHERE {_MARK} IS NOT NULL",
    "p1_terms": _TERMS
    + f""", p AS (SELECT record, field, term, lead(term) OVER (PARTITION BY id ORDER BY pos) AS following FROM s),
    b AS (SELECT field, term, following, count(*) AS occurrences, count(DISTINCT record) AS records FROM p WHERE following IS NOT NULL GROUP BY 1, 2, 3
      UNION ALL SELECT field, term, NULL, occurrences, records FROM m)
    SELECT field, term, following, occurrences, records, {_MARK} AS mark FROM b""",
    "p4_found": f"""
    WITH r AS (SELECT *, row_number() OVER g AS place, count(*) OVER (PARTITION BY tendable_type, tendable_id, facet) AS n
      FROM {_RECORDS.format("enliterator_visits")} WHERE started_at IS NOT NULL
      WINDOW g AS (PARTITION BY tendable_type, tendable_id, facet ORDER BY started_at DESC, id DESC))
    SELECT tendable_type, tendable_id, facet, id AS visit_id FROM r WHERE n > 3 AND place <= 3""",
}

SQL["p7_invariants"] = "SELECT 'documents' AS measure, count(*) AS n FROM documents UNION ALL SELECT unnest(['overfull', 'cut_though_fitting', 'torn']), 0"

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p4_found": p4_found, "p5_found": p5_found, "p5_names": p5_names, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_invariants": p7_invariants, "p8_statistics": p8_statistics, "p8_found": p8_found}
