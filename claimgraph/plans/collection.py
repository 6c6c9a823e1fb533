"""Queries of briefs, plans, states, searches and name groups, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimgraph.functions import text
from claimgraph.operators import audits, brief, catalog, claims, graph, name_groups, scope, survey, visits, vocabulary
from claimgraph.plans import condition, store
from claimgraph.plans.condition import _DOC, _LIVE, _surveyed
from claimgraph.plans.store import MONTH, RECORD, THEN, _a, _c, _contexts, _m, _query, _suggestions, _v
from claimgraph.sources import table

_SINCE = ", w AS (SELECT * FROM v WHERE created_at > TIMESTAMP '2031-06-01')"
NAME_KEYS = ("advisor", "authored_by", "contributor", "corporate_author")


def _recent(spark, d, *columns):
    return visits.since(_v(spark, d, *columns, "created_at"), MONTH, inclusive=False)


@_query(
    _SINCE
    + """SELECT 'facet' AS dimension, facet AS label, status, count(*) AS n, coalesce(sum(tokens_total), 0)::BIGINT AS tokens FROM w GROUP BY facet, status
    UNION ALL SELECT 'tier', coalesce(tier, '—'), NULL, count(*), coalesce(sum(tokens_total), 0)::BIGINT FROM w GROUP BY coalesce(tier, '—')
    UNION ALL SELECT 'reason', coalesce(reason, '—'), NULL, count(*), coalesce(sum(tokens_total), 0)::BIGINT FROM w GROUP BY coalesce(reason, '—')"""
)
def brief_activity(spark, d):
    return brief.activity(_recent(spark, d, "facet", "status", "tier", "reason", "tokens_total"))


@_query(
    _SINCE
    + """SELECT count(DISTINCT heartbeat_id) AS cycles, count(*) AS visits, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (reason = 'deep_read') AS deep_reads,
    count(DISTINCT (tendable_type, tendable_id)) AS records, coalesce(sum(tokens_total), 0)::BIGINT AS tokens FROM w"""
)
def brief_headline(spark, d):
    return brief.headline(_recent(spark, d, *RECORD, "status", "reason", "heartbeat_id", "tokens_total"))


@_query(_SINCE + ", f AS (SELECT * FROM w WHERE status = 'failed') SELECT id, tendable_type, tendable_id, facet, tier, (SELECT count(*) > 10 FROM f) AS truncated FROM f ORDER BY created_at DESC, id DESC LIMIT 10")
def brief_failures(spark, d):
    return brief.failures(_recent(spark, d, *RECORD, "status", "facet", "tier"))


#: The tables have no parts; a data set's visits stand for parts here, and the records of their contexts' keys for parents.
@_query(
    """, k AS (SELECT * FROM v WHERE reason = 'sweep'), pa AS (SELECT DISTINCT member_id AS part_id, 'Context' AS record_type, min(context_id)::VARCHAR AS record_id FROM m WHERE member_type = 'Dataset' GROUP BY 1)
    SELECT (SELECT count(*) FROM (SELECT record_type, record_id FROM k JOIN pa ON k.tendable_id = pa.part_id WHERE tendable_type = 'Dataset' UNION SELECT tendable_type, tendable_id FROM k WHERE tendable_type <> 'Dataset')) AS records,
    count(DISTINCT tendable_id) FILTER (tendable_type = 'Dataset' AND status = 'succeeded') AS parts_read, count(DISTINCT tendable_id) FILTER (tendable_type = 'Dataset' AND status = 'failed') AS parts_failed,
    count(DISTINCT (tendable_type, tendable_id, facet)) FILTER (tendable_type <> 'Dataset' AND status = 'succeeded') AS syntheses, coalesce(sum(tokens_total), 0)::BIGINT AS tokens FROM k"""
)
def brief_sessions(spark, d):
    parents = _m(spark, d).where("member_type = 'Dataset'").groupBy(F.col("member_id").alias("part_id")).agg(F.min("context_id").cast("string").alias("record_id")).withColumn("record_type", F.lit("Context"))
    return brief.sessions(_v(spark, d, *RECORD, "facet", "status", "reason", "tokens_total"), parents, "Dataset", "sweep")


@_query(
    """SELECT 'suggestion' AS kind, status AS label, count(*) AS n FROM s WHERE created_at > TIMESTAMP '2024-01-20' GROUP BY status
    UNION ALL SELECT 'audit', source || '/' || verdict, count(*) FROM a WHERE created_at > TIMESTAMP '2031-01-01' GROUP BY 2"""
)
def brief_motion(spark, d):
    told = _suggestions(spark, d).where(F.col("created_at") > F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz"))
    return brief.motion(told, _a(spark, d).where(F.col("created_at") > F.lit(datetime(2031, 1, 1)).cast("timestamp_ntz")))


@_query("SELECT heartbeat_id, status, count(*) AS n FROM v WHERE heartbeat_id IS NOT NULL GROUP BY 1, 2")
def ledger_compaction(spark, d):
    return brief.compacted(brief.executed(_v(spark, d, "heartbeat_id", "reason", "status")))


@_query(
    """, h AS (SELECT heartbeat_id, count(*) AS enqueued, count(*) FILTER (status IN ('succeeded', 'failed')) AS landed FROM v WHERE heartbeat_id IS NOT NULL GROUP BY 1)
    SELECT h.*, p.enqueued - p.landed AS previous_deficit FROM h LEFT JOIN h p ON p.heartbeat_id = h.heartbeat_id - 1"""
)
def drain_deficit(spark, d):
    return brief.deficits(_v(spark, d, "heartbeat_id", "status"))


_EST = """, g AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY created_at DESC, id DESC) AS r, row_number() OVER (ORDER BY created_at DESC, id DESC) AS q FROM v WHERE status = 'succeeded'),
    e0 AS (SELECT facet, CASE WHEN count(*) FILTER (applied) > 0 AND sum(coalesce(tokens_total, 0)) > 0 THEN greatest(sum(coalesce(tokens_total, 0))::BIGINT // count(*) FILTER (applied), 1) END AS est FROM g WHERE r <= 50 GROUP BY 1),
    w0 AS (SELECT CASE WHEN count(*) FILTER (applied) > 0 AND sum(coalesce(tokens_total, 0)) > 0 THEN greatest(sum(coalesce(tokens_total, 0))::BIGINT // count(*) FILTER (applied), 1) END AS est FROM g WHERE q <= 50),
    est AS (SELECT f.facet, coalesce(e0.est, (SELECT est FROM w0), 4000)::BIGINT AS est FROM (SELECT DISTINCT facet FROM v) f LEFT JOIN e0 ON e0.facet IS NOT DISTINCT FROM f.facet)"""


def _costs(spark, d):
    return visits.estimates(_v(spark, d, "facet", "status", "applied", "created_at", "tokens_total"))


@_query(
    _EST
    + """, i AS (SELECT tendable_type, tendable_id, facet, reason, row_number() OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY CASE reason WHEN 'source_change' THEN 1 WHEN 'neighborhood' THEN 2 WHEN 'vocabulary' THEN 3 WHEN 'frontier' THEN 4 ELSE 5 END, created_at, id) AS r FROM v WHERE reason IS NOT NULL),
    p AS (SELECT i.facet, reason, est FROM i JOIN est ON est.facet = i.facet WHERE i.r = 1)
    SELECT reason, facet, count(*) AS n, sum(est)::BIGINT AS tokens FROM p GROUP BY GROUPING SETS ((reason), (facet, reason), ())"""
)
def plan_counts(spark, d):
    return brief.plan_counts(condition.first_reasons(spark, d).join(_costs(spark, d), "facet"), "facet", "est")


@_query(
    store._LANES
    + _EST
    + """, n AS (SELECT facet, count(*) AS waiting FROM fr GROUP BY facet)
    SELECT coalesce(sum(waiting), 0)::BIGINT AS remaining, coalesce(sum(waiting * est), 0)::BIGINT AS tokens, ceil(coalesce(sum(waiting * est), 0) / 200000)::BIGINT AS cycles FROM n JOIN est ON est.facet = n.facet"""
)
def frontier_horizon(spark, d):
    waiting = store.frontier_lanes_count(spark, d).groupBy("facet").agg(F.sum("waiting").alias("waiting"))
    return brief.horizon(waiting, _costs(spark, d), 200_000)


@_query(
    """, r AS (SELECT tendable_type, tendable_id, facet, max(created_at) >= TIMESTAMP '2030-06-01' AS again FROM done GROUP BY 1, 2, 3 HAVING min(created_at) < TIMESTAMP '2030-06-01')
    SELECT count(*) AS tended, count(*) FILTER (again) AS rederived, count(*) FILTER (NOT again) AS remaining, coalesce(round(count(*) FILTER (again) / nullif(count(*), 0), 3), 0.0) AS share FROM r"""
)
def revalidation_progress(spark, d):
    return brief.progress(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at"), THEN)


@_query(
    """SELECT coalesce(reason, '—') AS reason, count(DISTINCT (tendable_type, tendable_id, facet)) AS items, coalesce(sum(tokens_total), 0)::BIGINT AS tokens, max(finished_at) AS last_at
    FROM v WHERE heartbeat_id = (SELECT max(heartbeat_id) FROM v) AND status = 'succeeded' GROUP BY 1"""
)
def live_pulse(spark, d):
    return brief.pulse(_v(spark, d, *RECORD, "facet", "heartbeat_id", "reason", "status", "tokens_total", "finished_at"))


@_query("SELECT 'visits' AS measure, count(*) AS n FROM v UNION ALL SELECT 'claims', count(*) FROM c UNION ALL SELECT 'live_claims', count(*) FROM lively UNION ALL SELECT 'contexts', count(*) FROM enliterator_contexts UNION ALL SELECT 'documents', count(*) FROM documents")
def collection_stats(spark, d):
    held = _c(spark, d, *_LIVE)
    return brief.strip(visits=_v(spark, d), claims=held, live_claims=held.where(claims.live()), contexts=_contexts(spark, d), documents=table(spark, d, "documents"))


@_query(
    """, ap AS (SELECT * FROM (VALUES ('summary', TIMESTAMP '2030-01-01'), ('subjects', TIMESTAMP '2030-03-01'), ('summary', TIMESTAMP '2030-06-01')) t(facet, approved_at)), nw AS (SELECT facet, max(approved_at) AS approved_at FROM ap GROUP BY 1),
    l AS (SELECT facet, tendable_type, tendable_id, max(started_at) AS last_started FROM done WHERE started_at IS NOT NULL GROUP BY 1, 2, 3),
    b AS (SELECT l.*, row_number() OVER (PARTITION BY l.facet ORDER BY last_started, tendable_type, tendable_id) AS place, count(*) OVER (PARTITION BY l.facet) AS n FROM l JOIN nw USING (facet) WHERE last_started < approved_at)
    SELECT facet, tendable_type, tendable_id, last_started, place::INT AS place, greatest(n - 40, 0) AS remaining FROM b WHERE place <= 40"""
)
def vocabulary_wave(spark, d):
    approvals = spark.createDataFrame([("summary", datetime(2030, 1, 1)), ("subjects", datetime(2030, 3, 1)), ("summary", THEN)], "facet string, approved_at timestamp_ntz")
    return brief.wave(_v(spark, d, *RECORD, "facet", "status", "applied", "started_at"), approvals, 40)


@_query(
    """, h AS (SELECT max(finished_at) AS seen FROM v WHERE heartbeat_id = (SELECT max(heartbeat_id) - 3 FROM v))
    SELECT facet, context_id, coalesce(max(created_at) > (SELECT seen FROM h), false) AS active FROM v GROUP BY 1, 2"""
)
def lane_activity(spark, d):
    log = _v(spark, d, "facet", "context_id", "created_at", "heartbeat_id", "finished_at")
    latest = log.agg((F.max("heartbeat_id") - 3).alias("heartbeat_id"))
    beat = log.join(F.broadcast(latest), "heartbeat_id").agg(F.max("finished_at").alias("at"))  # one row
    return brief.active_lanes(log, beat)


@_query(_DOC + "SELECT band, count(*) AS n, round(avg(score), 6) AS mean_score FROM surveyed GROUP BY 1")
def condition_report(spark, d):
    return survey.bands(_surveyed(spark, d))


@_query(
    """SELECT doc_id, 'legibility' AS probe, NOT (text IS NULL OR trim(text) = '') AS passed, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' END AS code FROM documents
    UNION ALL SELECT doc_id, 'size', length(text) = n_chars, CASE WHEN length(text) <> n_chars THEN 'differs' END FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL
    UNION ALL SELECT doc_id, 'lang', lang IS NOT NULL AND lang = lower(lang), CASE WHEN lang IS NULL THEN 'missing' WHEN lang <> lower(lang) THEN 'case' END FROM documents
    UNION ALL SELECT doc_id, 'record', tendable_id IS NOT NULL, CASE WHEN tendable_id IS NULL THEN 'none' END FROM documents"""
)
def condition_probes(spark, d):
    return survey.probed(table(spark, d, "documents"), ["doc_id"], condition.probes())


_DUE = """, ho AS (SELECT DISTINCT tendable_type, tendable_id FROM documents WHERE tendable_id IS NOT NULL), su AS (SELECT tendable_type, tendable_id, max(created_at) AS seen FROM done WHERE facet = 'summary' GROUP BY 1, 2),
    fr AS (SELECT *, row_number() OVER (PARTITION BY tendable_type ORDER BY tendable_id) AS place FROM ho WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.tendable_type = ho.tendable_type AND su.tendable_id = ho.tendable_id)),
    nv AS (SELECT tendable_type, tendable_id, 'never' AS origin, 0 AS part, NULL::TIMESTAMP AS seen FROM fr WHERE place <= 100 ORDER BY place > (SELECT greatest(100 // count(DISTINCT tendable_type), 1) FROM ho), tendable_type, place LIMIT 100),
    st AS (SELECT tendable_type, tendable_id, 'stale' AS origin, 1 AS part, seen FROM su ORDER BY seen, tendable_type, tendable_id LIMIT 100)
    SELECT tendable_type, tendable_id, origin FROM (SELECT * FROM nv UNION ALL SELECT * FROM st) ORDER BY part, seen, tendable_type, tendable_id LIMIT 100"""


@_query(_DUE)
def survey_due(spark, d):
    hosts = table(spark, d, "documents").where("tendable_id IS NOT NULL").select(*RECORD)
    read = visits.applied(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at")).where("facet = 'summary'")
    return survey.due(hosts, read.groupBy(*RECORD).agg(F.max("created_at").alias("computed_at")), 100)


@_query("SELECT tendable_type, tendable_id FROM (SELECT DISTINCT tendable_type, tendable_id FROM documents WHERE tendable_id IS NOT NULL) h WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.tendable_type = h.tendable_type AND v.tendable_id = h.tendable_id)")
def never_surveyed(spark, d):
    hosts = table(spark, d, "documents").where("tendable_id IS NOT NULL").select(*RECORD).distinct()
    return hosts.join(_v(spark, d, *RECORD).select(*RECORD), RECORD, "left_anti")


@_query("SELECT id, key, value, tier, confidence, status, attributed_to, created_at, CASE WHEN length(value) > 200 THEN left(value, 200) || '…' ELSE value END AS shown, coalesce(length(value) > 200, false) AS truncated FROM lively")
def claim_cards(spark, d):
    held = _c(spark, d, "key", "value", "tier", "confidence", *_LIVE, "attributed_to", "created_at").where(claims.live())
    return held.select("id", "key", "value", "tier", "confidence", "status", "attributed_to", "created_at", text.shortened(F.col("value"), 200).alias("shown"), F.coalesce(F.length("value") > 200, F.lit(False)).alias("truncated"))


@_query("SELECT id, facet, status, tier, model, confidence, reason, coalesce(tokens_total, 0) AS tokens, coalesce(n_added, 0) AS added, coalesce(n_updated, 0) AS updated, coalesce(n_deleted, 0) AS deleted, finished_at AS at FROM v")
def visit_states(spark, d):
    rows = _v(spark, d, "facet", "status", "tier", "model", "confidence", "reason", "tokens_total", "n_added", "n_updated", "n_deleted", "finished_at")
    zero = lambda c, to: F.coalesce(c, F.lit(0)).alias(to)
    return rows.select("id", "facet", "status", "tier", "model", "confidence", "reason", zero("tokens_total", "tokens"), zero("n_added", "added"), zero("n_updated", "updated"), zero("n_deleted", "deleted"), F.col("finished_at").alias("at"))


@_query(
    """, k AS (SELECT tendable_type, tendable_id, string_agg(key || '=' || coalesce(value, ''), chr(10) ORDER BY key, id) AS claims FROM lively WHERE key IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT tendable_type, tendable_id, id, row_number() OVER (PARTITION BY tendable_type, tendable_id ORDER BY created_at DESC, id DESC) AS back FROM done WHERE facet = 'summary'),
    l AS (SELECT tendable_type, tendable_id, string_agg(id::VARCHAR, ',' ORDER BY back) AS visits FROM r WHERE back <= 5 GROUP BY 1, 2)
    SELECT coalesce(k.tendable_type, l.tendable_type) AS tendable_type, coalesce(k.tendable_id, l.tendable_id) AS tendable_id, claims, visits FROM k FULL JOIN l ON k.tendable_type = l.tendable_type AND k.tendable_id = l.tendable_id"""
)
def literacy_states(spark, d):
    """Each record's live claims in order of key, and its last five applied visits on the facet 'summary'."""
    held = _c(spark, d, *RECORD, "key", "value", *_LIVE).where(claims.live() & F.col("key").isNotNull())
    line = F.struct("key", "id", F.concat("key", F.lit("="), F.coalesce("value", F.lit(""))).alias("line"))
    told = held.groupBy(*RECORD).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("claims"))
    newest = Window.partitionBy(*RECORD).orderBy(F.col("created_at").desc(), F.col("id").desc())
    last = visits.applied(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at")).where("facet = 'summary'").withColumn("back", F.row_number().over(newest)).where("back <= 5")
    seen = last.groupBy(*RECORD).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("back", "id"))), lambda x: x["id"].cast("string")), ",").alias("visits"))
    return told.join(seen, RECORD, "full_outer")


@_query(
    """, t AS (SELECT tendable_type, tendable_id, min_by(title, doc_id) FILTER (trim(title) <> '') AS title FROM documents WHERE tendable_id IS NOT NULL GROUP BY 1, 2)
    SELECT r.tendable_type, r.tendable_id, coalesce(t.title, r.tendable_type || ' #' || r.tendable_id) AS label FROM (SELECT DISTINCT tendable_type, tendable_id FROM v) r LEFT JOIN t ON t.tendable_type = r.tendable_type AND t.tendable_id = r.tendable_id"""
)
def record_labels(spark, d):
    """Each visited record's title, else its type and number."""
    titled = table(spark, d, "documents").where("tendable_id IS NOT NULL AND trim(title) <> ''").groupBy(*RECORD).agg(F.min_by("title", "doc_id").alias("title"))
    known = _v(spark, d, *RECORD).select(*RECORD).distinct()
    return known.join(titled, RECORD, "left").select(*RECORD, F.coalesce("title", F.concat("tendable_type", F.lit(" #"), "tendable_id")).alias("label"))


@_query("SELECT told.id, key, value, told.confidence, eff.verdict FROM told LEFT JOIN eff ON eff.claim_id = told.id WHERE tendable_type = 'Library' AND tendable_id = '1'")
def node_inspect(spark, d):
    """The live claims of one record with their effective verdicts."""
    held = _c(spark, d, *RECORD, "key", "value", "confidence", *_LIVE, "visit_id", "attributed_to").where(claims.live() & claims.understanding() & F.expr("tendable_type = 'Library' AND tendable_id = '1'"))
    judged = audits.effective(_a(spark, d)).select(F.col("claim_id").alias("id"), "verdict")
    return held.join(judged, "id", "left").select("id", "key", "value", "confidence", "verdict")


@_query("SELECT s, t, key, weight FROM edges WHERE coalesce(weight, 0) >= 0.7 AND category IN ('agent', 'subject') AND seen_at >= TIMESTAMP '2030-01-01' AND seen_at <= TIMESTAMP '2031-01-01'")
def atlas_filtered(spark, d):
    drawn = store._graph(spark, d)[1]
    return graph.filtered(drawn, 0.7, ["agent", "subject"], datetime(2030, 1, 1), datetime(2031, 1, 1)).select("s", "t", "key", "weight")


@_query(", n AS (SELECT t AS term, count(*) AS mentions FROM edges WHERE t LIKE 'term/%' GROUP BY 1) SELECT term, mentions FROM n WHERE (SELECT count(*) FROM n) <= 400 OR mentions >= 2 ORDER BY mentions DESC, term LIMIT 400")
def atlas_uncrowded(spark, d):
    return graph.uncrowded(store._graph(spark, d)[1], 400)


@_query(
    """, x AS (SELECT node, degree, CASE WHEN node LIKE 'context/%' THEN 'context' WHEN node LIKE 'term/%' THEN 'entity' ELSE 'record' END AS kind, lower(substr(node, instr(node, '/') + 1)) AS name FROM degree),
    y AS (SELECT *, (CASE kind WHEN 'context' THEN 100 WHEN 'entity' THEN CASE WHEN degree >= 10 THEN 60 ELSE 0 END ELSE CASE WHEN degree >= 10 THEN 80 ELSE 0 END END)::BIGINT AS priority FROM x)
    SELECT node, kind, degree, priority FROM y WHERE contains(name, 'harbour') ORDER BY name = 'harbour' DESC, priority DESC, degree DESC, node LIMIT 1"""
)
def node_search(spark, d):
    return graph.found(graph.nodes(store._graph(spark, d)[1]), "Harbour")


@_query(
    """SELECT 'out' AS direction, t AS other, key, weight FROM (SELECT * FROM edges WHERE s = 'Library/1' ORDER BY weight DESC NULLS LAST, t, key LIMIT 40)
    UNION ALL SELECT 'in', s, key, weight FROM (SELECT * FROM edges WHERE t = 'Library/1' ORDER BY weight DESC NULLS LAST, s, key LIMIT 40)"""
)
def connections(spark, d):
    return graph.connections(store._graph(spark, d)[1], "Library/1")


@_query(
    """, n AS (SELECT t AS node, seen_at FROM edges WHERE s = 'Library/1' UNION ALL SELECT s, seen_at FROM edges WHERE t = 'Library/1'), k AS (SELECT node, count(*) AS links, max(seen_at) AS seen FROM n GROUP BY 1)
    SELECT node, links, degree FROM k JOIN degree USING (node) ORDER BY seen DESC NULLS LAST, node LIMIT 40"""
)
def neighbors_by_recency(spark, d):
    return graph.neighbours(store._graph(spark, d)[1], "Library/1", 40, "recency")


@_query(
    """, x AS (SELECT context_id, tendable_type, tendable_id, count(*) AS n FROM told WHERE context_id IS NOT NULL GROUP BY 1, 2, 3)
    SELECT context_id, tendable_type, tendable_id, n FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY n DESC, tendable_type, tendable_id) AS r FROM x) WHERE r <= 8"""
)
def context_leaders(spark, d):
    """The eight records of each context with most live claims."""
    held = _c(spark, d, *RECORD, "context_id", *_LIVE, "visit_id", "attributed_to").where(claims.live() & claims.understanding() & F.col("context_id").isNotNull())
    counted = held.groupBy("context_id", *RECORD).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("context_id").orderBy(F.col("n").desc(), *RECORD))
    return counted.withColumn("r", place).where("r <= 8").drop("r")


@_query("SELECT tendable_type, tendable_id FROM (SELECT DISTINCT tendable_type, tendable_id FROM v WHERE tendable_id IS NOT NULL) ORDER BY md5('s7' || tendable_type || '/' || tendable_id), tendable_type, tendable_id LIMIT 1")
def wander(spark, d):
    """One record, drawn by a seeded hash."""
    known = _v(spark, d, *RECORD).where("tendable_id IS NOT NULL").select(*RECORD).distinct()
    return known.orderBy(F.md5(F.concat(F.lit("s7"), "tendable_type", F.lit("/"), "tendable_id")), *RECORD).limit(1)


@_query(
    """, t AS (SELECT node, key, trim(term) AS term FROM named WHERE key IN ('advisor', 'authored_by', 'contributor', 'corporate_author')), f AS (SELECT term AS name, count(DISTINCT node) AS freq FROM t GROUP BY 1),
    z AS (SELECT name, freq, lower(trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', ''), '(?i),?\\s*(ph\\.?\\s*d\\.?|esq(?:uire)?\\.?|m\\.?\\s*d\\.?|j\\.?\\s*d\\.?|ed\\.?\\s*d\\.?)\\s*$', ''),
      'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC'), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g'))) AS norm FROM f),
    k AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> '' AND replace(x, '.', '') NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS w FROM z),
    g AS (SELECT name, freq, norm, w[1] AS first, array_to_string(list_transform(w[2:len(w) - 1], lambda x: left(x, 1)), ' ') AS middle, w[-1] AS surname, len(string_split_regex(trim(name), '\\s+')) AS words FROM k WHERE len(w) >= 2),
    kn AS (SELECT DISTINCT surname FROM g WHERE freq >= 2),
    du AS (SELECT name FROM (SELECT name, unnest(list_distinct(string_split(norm, ' ')[2:])) AS word FROM g) JOIN kn ON word = surname GROUP BY name HAVING count(*) >= 2),
    q AS (SELECT first, surname, list_sort(list(name)) AS variants, count(DISTINCT nullif(middle, '')) AS middles, arg_min(name, (instr(name, '(') > 0, -freq, -words, name)) AS best FROM g WHERE name NOT IN (SELECT name FROM du) GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT name AS canonical, name AS variants, 'held' AS status FROM du UNION ALL SELECT CASE WHEN middles > 1 THEN variants[1] ELSE best END, array_to_string(variants, ' | '), CASE WHEN middles > 1 THEN 'held' ELSE 'auto' END FROM q"""
)
def grouped_names(spark, d):
    held = _c(spark, d, *RECORD, "key", "value", "confidence", *_LIVE, "visit_id", "attributed_to", "created_at")
    spoken = graph.named(held).where(F.col("key").isin(*NAME_KEYS)).select("node", F.trim("term").alias("name"))
    counted = spoken.groupBy("name").agg(F.count_distinct("node").alias("freq"))
    return name_groups.groups(counted, "name", "freq").select("canonical", F.array_join("variants", " | ").alias("variants"), "status")


@_query(
    """, g AS (SELECT facet, proposed_key, count(DISTINCT (tendable_type, tendable_id)) AS demand, min_by(created_at, id) AS first_at FROM s WHERE status = 'pending' GROUP BY 1, 2)
    SELECT * FROM (SELECT facet, proposed_key, demand, first_at, row_number() OVER (PARTITION BY facet ORDER BY demand DESC, proposed_key)::INT AS place FROM g WHERE proposed_key NOT IN (SELECT proposed_key FROM s WHERE status <> 'pending')) WHERE place <= 20"""
)
def vocabulary_candidates(spark, d):
    return vocabulary.candidates(_suggestions(spark, d), 20)


@_query(
    """, x AS (SELECT proposed_key, tendable_id, facet, min(id) AS id FROM s GROUP BY 1, 2, 3)
    SELECT proposed_key, tendable_id, facet, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY proposed_key ORDER BY id) AS place FROM x) WHERE place <= 12"""
)
def key_evidence(spark, d):
    return vocabulary.evidence(_suggestions(spark, d), 12)


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_SIGNIFICANT = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}) AND (length(x) >= 4 OR regexp_full_match(x, '[0-9]+'))))"


@_query(f", t AS (SELECT doc_id, {_SIGNIFICANT.format('title')} AS w, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}))) AS b FROM documents) SELECT doc_id, len(w) AS significant, CASE WHEN len(w) > 0 THEN round(len(list_intersect(w, b)) / len(w), 6) END AS overlap, coalesce(len(w) > 0 AND len(list_intersect(w, b)) / len(w) < 0.4, false) AS absent FROM t")
def title_overlap(spark, d):
    """How many of a title's significant words its text has, and whether the title says something else."""
    title, body = text.significant(F.col("title")), text.words(F.col("text"))
    shared = F.size(F.array_intersect("w", "b")) / F.size("w")
    told = table(spark, d, "documents").select("doc_id", title.alias("w"), body.alias("b"))
    return told.select("doc_id", F.size("w").cast("bigint").alias("significant"), F.when(F.size("w") > 0, F.round(shared, 6)).alias("overlap"), F.coalesce((F.size("w") > 0) & (shared < 0.4), F.lit(False)).alias("absent"))


@_query(
    """SELECT coalesce(m.facet, f.facet) AS facet, coalesce(m.open, 0) AS open, coalesce(m.records, 0) AS records, coalesce(f.failed, 0) AS failed FROM
    (SELECT facet, count(*) AS open, count(DISTINCT (tendable_type, tendable_id)) AS records FROM v WHERE status IN ('pending', 'running') GROUP BY 1) m FULL JOIN (SELECT facet, count(*) AS failed FROM v WHERE status = 'failed' GROUP BY 1) f ON f.facet = m.facet"""
)
def open_work(spark, d):
    """Visits not yet ended, and failed ones, by facet."""
    log = _v(spark, d, *RECORD, "facet", "status").where("facet IS NOT NULL")
    open_ = F.col("status").isin("pending", "running")
    counted = log.groupBy("facet").agg(F.count_if(open_).alias("open"), F.count_distinct(F.when(open_, F.struct(*RECORD))).alias("records"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counted.where("open > 0 OR failed > 0")


@_query("SELECT day, count(*) FILTER (NOT cycled) AS without_cycle, count(*) FILTER (cycled) AS with_cycle FROM (SELECT created_at::DATE AS day, heartbeat_id IS NOT NULL AS cycled FROM v WHERE status = 'failed' AND created_at IS NOT NULL) GROUP BY 1")
def failures_per_day(spark, d):
    failed = _v(spark, d, "created_at", "status", "heartbeat_id").where("status = 'failed' AND created_at IS NOT NULL")
    return failed.groupBy(F.to_date("created_at").alias("day")).agg(F.count_if(F.col("heartbeat_id").isNull()).alias("without_cycle"), F.count_if(F.col("heartbeat_id").isNotNull()).alias("with_cycle"))


@_query(
    """, r AS (SELECT x.id, x.key, x.parent_id, up.depth, up.ancestor_id FROM enliterator_contexts x JOIN up ON up.context_id = x.id)
    SELECT x.id, string_agg(y.key, '/' ORDER BY r.depth DESC) AS path, max(r.depth) AS depth, (SELECT count(*) FROM enliterator_contexts z WHERE z.parent_id = x.id) AS children FROM enliterator_contexts x JOIN r ON r.id = x.id JOIN enliterator_contexts y ON y.id = r.ancestor_id GROUP BY x.id"""
)
def context_paths(spark, d):
    """Every context's path from the top, depth and number of children."""
    known = _contexts(spark, d)
    up = scope.closure(known).join(known.select(F.col("id").alias("ancestor_id"), "key"), "ancestor_id")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("o"), "key"))), lambda x: x["key"]), "/")
    paths = up.groupBy(F.col("context_id").alias("id")).agg(line.alias("path"), F.max("depth").alias("depth"))
    kids = known.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return paths.join(kids, "id", "left").select("id", "path", "depth", F.coalesce("children", F.lit(0).cast("bigint")).alias("children"))


@_query(
    """, p AS (SELECT facet, model, created_at >= TIMESTAMP '2031-01-01' AS late, count(*) AS n FROM v WHERE status = 'failed' AND created_at >= TIMESTAMP '2030-01-01' GROUP BY 1, 2, 3)
    SELECT coalesce(a.facet, b.facet) AS facet, coalesce(a.model, b.model) AS model, b.n AS known, a.n AS n, a.n IS DISTINCT FROM b.n AS changed FROM (SELECT * FROM p WHERE late) a
    FULL JOIN (SELECT * FROM p WHERE NOT late) b ON a.facet IS NOT DISTINCT FROM b.facet AND a.model IS NOT DISTINCT FROM b.model"""
)
def pile_changes(spark, d):
    """Failures by facet and model of the last half year against those of the year before."""
    failed = _v(spark, d, "facet", "model", "status", "created_at").where("status = 'failed'")
    start, cut = (F.lit(datetime(y, 1, 1)).cast("timestamp_ntz") for y in (2030, 2031))
    pile = lambda rows: rows.groupBy("facet", "model").agg(F.count("*").alias("n"))
    return survey.sightings(pile(failed.where((F.col("created_at") >= start) & (F.col("created_at") < cut))), pile(failed.where(F.col("created_at") >= cut)), ["facet", "model"])


@_query("SELECT DISTINCT tendable_type FROM (SELECT tendable_type FROM v WHERE tendable_type NOT LIKE '%::%' UNION SELECT unnest(['Thesis', 'Atlas', 'Collection'])) WHERE tendable_type NOT IN ('Collection', 'Dataset')")
def host_corpus(spark, d):
    return catalog.corpus(_v(spark, d, "tendable_type"), ["Thesis", "Atlas", "Collection"], ["Collection", "Dataset"])


#: Every third context declares a tier here, as the contexts have none.
@_query(
    """, p AS (SELECT id, CASE id % 2 WHEN 0 THEN 'quality' ELSE 'cheap' END AS tier FROM enliterator_contexts WHERE id % 3 = 1)
    SELECT up.context_id, min_by(p.tier, depth) AS tier, min_by(p.id, depth) AS origin FROM up JOIN p ON p.id = up.ancestor_id GROUP BY 1"""
)
def context_policy(spark, d):
    known = _contexts(spark, d)
    declared = known.where("id % 3 = 1").select(F.col("id").alias("context_id"), F.when(F.col("id") % 2 == 0, "quality").otherwise("cheap").alias("tier"))
    return scope.nearest(scope.closure(known), declared, "tier")


@_query(
    """, o AS (SELECT DISTINCT facet, proposed_key AS key FROM s WHERE status = 'mapped'), p AS (SELECT DISTINCT facet, proposed_key AS key FROM s WHERE status IN ('approved', 'pending'))
    SELECT coalesce(o.facet, p.facet) AS facet, coalesce(o.key, p.key) AS key, CASE WHEN o.key IS NOT NULL THEN 'own' ELSE 'approved' END AS origin FROM o FULL JOIN p ON o.facet = p.facet AND o.key = p.key"""
)
def effective_terms(spark, d):
    rows = _suggestions(spark, d).select("facet", F.col("proposed_key").alias("key"), "status")
    return vocabulary.overlay(rows.where("status = 'mapped'").drop("status"), rows.where("status IN ('approved', 'pending')").drop("status"))


QUERIES, SQL = store.QUERIES, store.SQL
