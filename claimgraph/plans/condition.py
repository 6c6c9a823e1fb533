"""Queries of surveys, provenance, reconciliation and differences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimgraph.operators import claims, graph, planner, sections, survey, visits
from claimgraph.plans import store
from claimgraph.plans.store import MONTH, RECORD, THEN, _a, _c, _contexts, _m, _query, _v
from claimgraph.sources import table

_LIVE = ("superseded_by_id", "status")
_DOC = """, p AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'legibility:no_text' END AS f1, CASE WHEN text IS NOT NULL AND length(text) <> n_chars THEN 'size:differs' END AS f2,
    CASE WHEN lang IS NULL THEN 'lang:missing' WHEN lang <> lower(lang) THEN 'lang:case' END AS f3, CASE WHEN tendable_id IS NULL THEN 'record:none' END AS f4, text IS NOT NULL AND n_chars IS NOT NULL AS sized FROM documents),
    g AS (SELECT doc_id, nullif(array_to_string(list_sort(list_filter([f1, f2, f3, f4], lambda x: x IS NOT NULL)), '+'), '') AS signature, f1 IS NOT NULL AS gated, sized FROM p),
    surveyed AS (SELECT doc_id, signature, CASE WHEN gated THEN 'untendable' WHEN signature IS NOT NULL THEN 'degraded' ELSE 'sound' END AS band,
    CASE WHEN gated THEN 0.0 WHEN signature IS NOT NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS score, 3 + sized::INT AS checked FROM g)"""


def probes():
    """The probes of the queries below: name to (passes, code, gating)."""
    lang = F.col("lang")
    return {
        "legibility": (F.col("text").isNotNull() & (F.trim("text") != ""), F.lit("no_text"), True),
        "size": (F.length("text") == F.col("n_chars"), F.lit("differs"), False),
        "lang": (lang.isNotNull() & (F.coalesce(lang, F.lit("")) == F.lower(F.coalesce(lang, F.lit("")))), F.when(lang.isNull(), "missing").otherwise("case"), False),
        "record": (F.col("tendable_id").isNotNull(), F.lit("none"), False),
    }


def _surveyed(spark, d):
    return survey.survey(table(spark, d, "documents"), ["doc_id"], probes())


@_query(_DOC + "SELECT * FROM surveyed")
def condition_survey(spark, d):
    return _surveyed(spark, d)


@_query(_DOC + ", r AS (SELECT signature, doc_id, row_number() OVER (PARTITION BY signature ORDER BY doc_id DESC) AS r FROM surveyed WHERE signature IS NOT NULL) SELECT signature, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS samples FROM r GROUP BY 1")
def condition_piles(spark, d):
    return survey.piles(_surveyed(spark, d).where("signature IS NOT NULL"), ["signature"], "doc_id", "doc_id")


@_query(
    """, r AS (SELECT facet, model, id, row_number() OVER (PARTITION BY facet, model ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM v WHERE status = 'failed')
    SELECT facet, model, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS samples FROM r GROUP BY 1, 2"""
)
def failure_piles(spark, d):
    return survey.piles(_v(spark, d, "facet", "model", "status", "created_at").where("status = 'failed'"), ["facet", "model"], "id", "created_at")


@_query(
    """, r AS (SELECT tendable_type, tendable_id, count(*) AS visits FROM done GROUP BY 1, 2 HAVING count(*) >= 2) SELECT r.* FROM r
    WHERE NOT EXISTS (SELECT 1 FROM lively l WHERE l.tendable_type = r.tendable_type AND l.tendable_id = r.tendable_id) AND EXISTS (SELECT 1 FROM m WHERE m.member_type = r.tendable_type AND m.member_id = r.tendable_id)"""
)
def residue(spark, d):
    return survey.residue(_v(spark, d, *RECORD, "status", "applied"), _c(spark, d, *RECORD, *_LIVE), _m(spark, d), 2)


@_query("SELECT DISTINCT tendable_type, tendable_id, facet FROM done WHERE created_at < TIMESTAMP '2030-06-01' AND (tendable_type, tendable_id, facet) NOT IN (SELECT tendable_type, tendable_id, facet FROM done WHERE created_at >= TIMESTAMP '2030-06-01')")
def revalidation_targets(spark, d):
    return survey.not_since(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at"), THEN)


@_query("SELECT context_id, member_type, member_id FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY md5('s1' || (member_type || '/' || member_id)), member_type || '/' || member_id) AS r FROM m) WHERE r <= 5")
def sampled_members(spark, d):
    rows = _m(spark, d).withColumn("name", F.concat("member_type", F.lit("/"), "member_id"))
    return survey.drawn(rows, "name", "context_id", 5, "s1").select("context_id", "member_type", "member_id")


@_query(
    """SELECT source, verdict, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, round(stddev_pop(confidence), 4) AS spread, round(avg(pow(confidence - CASE WHEN verdict = 'supported' THEN 1.0 ELSE 0.0 END, 2)), 4) AS brier
    FROM a WHERE confidence IS NOT NULL AND verdict <> 'unverifiable' GROUP BY GROUPING SETS ((source, verdict), (source))"""
)
def calibration(spark, d):
    return survey.calibration(_a(spark, d))


@_query(
    """SELECT coalesce(m.context_id, w.context_id) AS context_id, coalesce(m.member_type, w.member_type) AS member_type, coalesce(m.member_id, w.member_id) AS member_id, CASE WHEN m.context_id IS NULL THEN 'insert' ELSE 'delete' END AS change
    FROM m FULL JOIN (SELECT DISTINCT context_id, tendable_type AS member_type, tendable_id AS member_id FROM lively WHERE context_id IS NOT NULL) w ON w.context_id = m.context_id AND w.member_type = m.member_type AND w.member_id = m.member_id
    WHERE m.context_id IS NULL OR w.context_id IS NULL"""
)
def topology_diff(spark, d):
    wanted = _c(spark, d, *RECORD, "context_id", *_LIVE).where(claims.live() & F.col("context_id").isNotNull())
    return survey.difference(_m(spark, d), wanted.select("context_id", F.col("tendable_type").alias("member_type"), F.col("tendable_id").alias("member_id")), ["context_id", "member_type", "member_id"])


@_query("SELECT id, key, name FROM enliterator_contexts x WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.context_id = x.id AND facet = 'chronology') AND NOT EXISTS (SELECT 1 FROM m WHERE m.context_id = x.id AND member_type = 'Dataset')")
def unplaced_contexts(spark, d):
    """Contexts without a chronology reading and without data sets."""
    read = visits.applied(_v(spark, d, "context_id", "facet", "status", "applied")).where("facet = 'chronology'").select("context_id")
    return survey.unreferenced(_contexts(spark, d), "id", read, _m(spark, d).where("member_type = 'Dataset'").select("context_id")).select("id", "key", "name")


@_query("SELECT heartbeat_id, reason, status, count(*) AS n, coalesce(sum(tokens_total), 0)::BIGINT AS tokens FROM v WHERE heartbeat_id IS NOT NULL GROUP BY 1, 2, 3")
def executed_by_cycle(spark, d):
    rows = _v(spark, d, "heartbeat_id", "reason", "status", "tokens_total").where("heartbeat_id IS NOT NULL")
    return rows.groupBy("heartbeat_id", "reason", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens"))


@_query("SELECT tendable_type, tendable_id, facet, id, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY created_at DESC, id DESC) AS back FROM done) WHERE back <= 5")
def last_visits(spark, d):
    newest = Window.partitionBy(*RECORD, "facet").orderBy(F.col("created_at").desc(), F.col("id").desc())
    rows = visits.applied(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at")).withColumn("back", F.row_number().over(newest))
    return rows.where("back <= 5").select(*RECORD, "facet", "id", "back")


@_query("SELECT claim_id, source, verdict FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE source WHEN 'human' THEN 3 WHEN 'examiner' THEN 2 ELSE 1 END DESC, created_at DESC, id DESC) AS r FROM a) WHERE r = 1")
def latest_verdicts(spark, d):
    rank = F.when(F.col("source") == "human", 3).when(F.col("source") == "examiner", 2).otherwise(1)
    best = F.max_by(F.struct("source", "verdict"), F.struct(rank.alias("k"), "created_at", "id")).alias("b")
    return _a(spark, d).groupBy("claim_id").agg(best).select("claim_id", "b.source", "b.verdict")


@_query(
    """SELECT c.id, v.id AS visit_id, v.facet, v.model, s.id AS successor_id, (SELECT count(*) FROM c p WHERE p.superseded_by_id = c.id) AS predecessors, (SELECT count(*) FROM a WHERE a.claim_id = c.id) AS audits
    FROM c LEFT JOIN v ON v.id = c.visit_id LEFT JOIN c s ON s.id = c.superseded_by_id"""
)
def provenance(spark, d):
    rows = _c(spark, d, "visit_id", "superseded_by_id")
    made = _v(spark, d, "facet", "model").withColumnRenamed("id", "v")
    before = rows.groupBy(F.col("superseded_by_id").alias("s")).agg(F.count("*").alias("predecessors"))
    heard = _a(spark, d).groupBy(F.col("claim_id").alias("a")).agg(F.count("*").alias("audits"))
    there = rows.select(F.col("id").alias("successor_id"))
    joined = rows.join(made, F.col("visit_id") == F.col("v"), "left").join(there, F.col("superseded_by_id") == F.col("successor_id"), "left").join(before, F.col("id") == F.col("s"), "left").join(heard, F.col("id") == F.col("a"), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("id", F.col("v").alias("visit_id"), "facet", "model", "successor_id", F.coalesce("predecessors", zero).alias("predecessors"), F.coalesce("audits", zero).alias("audits"))


@_query(
    """, h AS (SELECT tendable_type, tendable_id, context_id, key, max_by(id, (created_at, id)) AS live_id, max_by(locked, (created_at, id)) AS locked FROM lively GROUP BY 1, 2, 3, 4),
    p AS (SELECT c.id, c.tendable_type, c.tendable_id, c.context_id, c.key, c.value, CASE c.id % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' END AS given, h.live_id AS first_id, coalesce(h.locked, false) AS locked, trim(coalesce(c.value, '')) IN ('', '""', 'null', '[]', '{}') AS blank
      FROM c LEFT JOIN h ON h.tendable_type IS NOT DISTINCT FROM c.tendable_type AND h.tendable_id IS NOT DISTINCT FROM c.tendable_id AND h.context_id IS NOT DISTINCT FROM c.context_id AND h.key IS NOT DISTINCT FROM c.key WHERE c.status = 'superseded'),
    q AS (SELECT *, locked AND first_id IS NOT NULL AND NOT coalesce(bool_or(given = 'ADD') OVER b, false) AS fixed FROM p WINDOW b AS (PARTITION BY tendable_type, tendable_id, context_id, key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, CASE WHEN given = 'DELETE' THEN CASE WHEN NOT fixed THEN 0 END WHEN given IS NULL OR given = 'ADD' OR NOT blank THEN 1 END AS after FROM q),
    y AS (SELECT *, coalesce(last_value(after IGNORE NULLS) OVER b, (first_id IS NOT NULL)::INT) = 1 AS here, coalesce(bool_or(after IS NOT NULL AND (NOT fixed OR coalesce(given, '') = 'ADD')) OVER b, false) AS changed FROM x WINDOW b AS (PARTITION BY tendable_type, tendable_id, context_id, key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    w AS (SELECT *, coalesce(given, CASE WHEN here THEN 'UPDATE' ELSE 'ADD' END) AS asked FROM y)
    SELECT tendable_type, tendable_id, context_id, key, id, CASE WHEN asked = 'ADD' THEN 'ADD' WHEN here AND fixed THEN 'NOOP' WHEN asked = 'DELETE' THEN CASE WHEN here THEN 'DELETE' ELSE 'NOOP' END WHEN here THEN asked WHEN blank THEN 'NOOP' ELSE 'ADD' END AS op,
    CASE WHEN NOT changed THEN first_id END AS live_id, value FROM w"""
)
def reconcile_ops(spark, d):
    rows = _c(spark, d, *RECORD, "context_id", "key", "value", *_LIVE, "locked", "created_at")
    op = F.when(F.col("id") % 4 == 0, "ADD").when(F.col("id") % 4 == 1, "update").when(F.col("id") % 4 == 2, "DELETE")
    return claims.reconcile(rows, rows.where("status = 'superseded'").withColumn("op", op))


@_query(
    """, d AS (SELECT tendable_type, tendable_id, min_by(md5(text), (captured_at, doc_id)) AS first_digest, max_by(md5(text), (captured_at, doc_id)) AS last_digest, count(*) AS texts FROM documents WHERE text IS NOT NULL AND tendable_id IS NOT NULL GROUP BY 1, 2)
    SELECT tendable_type, tendable_id, texts, first_digest <> last_digest AS drifted FROM d WHERE texts > 1"""
)
def digest_drift(spark, d):
    held = table(spark, d, "documents").where("text IS NOT NULL AND tendable_id IS NOT NULL").select(*RECORD, F.md5("text").alias("digest"), F.struct("captured_at", "doc_id").alias("k"))
    ends = held.groupBy(*RECORD).agg(F.min_by("digest", "k").alias("a"), F.max_by("digest", "k").alias("b"), F.count("*").alias("texts")).where("texts > 1")
    return ends.select(*RECORD, "texts", (F.col("a") != F.col("b")).alias("drifted"))


@_query(
    """, x AS (SELECT id, tendable_type, tendable_id, value::JSON->>'$' AS quote FROM lively WHERE json_type(value::JSON) = 'VARCHAR'), d AS (SELECT doc_id, tendable_type, tendable_id, text FROM documents WHERE text IS NOT NULL)
    SELECT x.id, d.doc_id, substr(text, greatest(instr(text, quote) - 80, 1)::INT, 400) AS context FROM x JOIN d USING (tendable_type, tendable_id) WHERE length(quote) >= 4 AND instr(text, quote) > 0"""
)
def quotes(spark, d):
    rows = _c(spark, d, *RECORD, "value", *_LIVE).where(claims.live())
    parsed = F.try_parse_json("value")
    told = rows.select("id", *RECORD, F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).alias("quote")).where("length(quote) >= 4")
    joined = told.join(table(spark, d, "documents").select("doc_id", *RECORD, "text").where("text IS NOT NULL"), RECORD)
    return joined.select("id", "doc_id", sections.located(F.col("text"), F.col("quote")).alias("context")).where("context IS NOT NULL")


@_query(
    """, n AS (SELECT unnest(list_append(variants, canonical)) AS variant, canonical FROM enliterator_name_authorities), u AS (SELECT variant, min(canonical) AS canonical FROM n GROUP BY 1)
    SELECT coalesce(u.canonical, x.term) AS name, count(DISTINCT x.node) AS records FROM named x LEFT JOIN u ON u.variant = x.term WHERE x.key IN ('advisor', 'authored_by', 'contributor', 'corporate_author') GROUP BY 1"""
)
def name_frequency(spark, d):
    held = _c(spark, d, *RECORD, "key", "value", "confidence", *_LIVE, "visit_id", "attributed_to", "created_at")
    known = table(spark, d, "enliterator_name_authorities").select(F.explode(F.array_append("variants", F.col("canonical"))).alias("variant"), "canonical").groupBy("variant").agg(F.min("canonical").alias("canonical"))
    named = graph.named(held).where(F.col("key").isin("advisor", "authored_by", "contributor", "corporate_author"))
    joined = named.join(known, F.col("term") == F.col("variant"), "left")
    return joined.groupBy(F.coalesce("canonical", "term").alias("name")).agg(F.count_distinct("node").alias("records"))


@_query("SELECT tendable_type, facet, count(*) AS n, count(DISTINCT tendable_id) AS records FROM v WHERE created_at >= TIMESTAMP '2031-06-01' GROUP BY 1, 2")
def recent_activity(spark, d):
    rows = visits.since(_v(spark, d, *RECORD, "facet", "created_at"), MONTH)
    return rows.groupBy("tendable_type", "facet").agg(F.count("*").alias("n"), F.count_distinct("tendable_id").alias("records"))


@_query(
    store._LANES
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY created_at DESC, id DESC) AS r, row_number() OVER (ORDER BY created_at DESC, id DESC) AS q FROM v WHERE status = 'succeeded'),
    e0 AS (SELECT facet, CASE WHEN count(*) FILTER (applied) > 0 AND sum(coalesce(tokens_total, 0)) > 0 THEN greatest(sum(coalesce(tokens_total, 0))::BIGINT // count(*) FILTER (applied), 1) END AS est FROM g WHERE r <= 50 GROUP BY 1),
    w0 AS (SELECT CASE WHEN count(*) FILTER (applied) > 0 AND sum(coalesce(tokens_total, 0)) > 0 THEN greatest(sum(coalesce(tokens_total, 0))::BIGINT // count(*) FILTER (applied), 1) END AS est FROM g WHERE q <= 50),
    k AS (SELECT fr.*, coalesce(e0.est, (SELECT est FROM w0), 4000)::BIGINT AS cost FROM fr LEFT JOIN e0 ON e0.facet IS NOT DISTINCT FROM fr.facet),
    l AS (SELECT facet, context_id, count(*) AS n, max(cost) AS cost FROM k GROUP BY 1, 2),
    o AS (SELECT *, least(n, (2000000 // count(*) OVER ()) // cost) AS first FROM l),
    h AS (SELECT count(*) FILTER (first > 0 AND first < n) AS hungry, 2000000 - sum(first * cost) AS spare FROM o),
    t AS (SELECT facet, context_id, first + CASE WHEN first > 0 AND first < n THEN least(n - first, (SELECT spare // hungry FROM h) // cost) ELSE 0 END AS take FROM o)
    SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY facet, context_id ORDER BY created_at, member_type, member_id)::INT AS place FROM k) p
    WHERE place <= (SELECT take FROM t WHERE t.facet IS NOT DISTINCT FROM p.facet AND t.context_id IS NOT DISTINCT FROM p.context_id)"""
)
def budget_plan(spark, d):
    """What 2,000,000 tokens afford of the frontier, shared fairly among all lanes (facet by context, the root included)."""
    wanted, log = store._lanes(spark, d)
    cost = visits.estimates(_v(spark, d, "facet", "status", "applied", "created_at", "tokens_total"))
    waiting = visits.frontier_lanes(wanted, log).alias("w").join(cost.alias("c"), F.col("w.facet").eqNullSafe(F.col("c.facet"))).select("w.*", F.col("c.est").alias("cost"), F.struct("w.facet", "w.context_id").alias("lane"))
    return planner.planned(waiting, "lane", "cost", [F.col("created_at").asc_nulls_last(), F.col("member_type"), F.col("member_id")], 2_000_000).drop("lane")


@_query(
    """, i AS (SELECT tendable_type, tendable_id, facet, reason, row_number() OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY CASE reason WHEN 'source_change' THEN 1 WHEN 'neighborhood' THEN 2 WHEN 'vocabulary' THEN 3 WHEN 'frontier' THEN 4 ELSE 5 END, created_at, id) AS r
    FROM v WHERE reason IS NOT NULL) SELECT tendable_type, tendable_id, facet, reason FROM i WHERE r = 1"""
)
def first_reasons(spark, d):
    rows = _v(spark, d, *RECORD, "facet", "reason", "created_at").where("reason IS NOT NULL")
    rank = F.when(F.col("reason") == "source_change", 1).when(F.col("reason") == "neighborhood", 2).when(F.col("reason") == "vocabulary", 3).when(F.col("reason") == "frontier", 4).otherwise(5)
    return planner.first_reason(rows, [*RECORD, "facet"], F.struct(rank.alias("k"), "created_at", "id")).select(*RECORD, "facet", "reason")


QUERIES, SQL = store.QUERIES, store.SQL
