"""Queries over the claim store's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import fnv1a, shortened, terms
from claimgraph.operators import audits, catalog, claims, graph, hierarchy, scope, sections, trajectory, vectors, visits, vocabulary
from claimgraph.plans.dealt import _RECORDS
from claimgraph.sources import records, stage, table
from claimgraph.streaming import visits as stream

RECORD = ["tendable_type", "tendable_id"]
NOW, THEN, MONTH = datetime(2031, 7, 1), datetime(2030, 6, 1), datetime(2031, 6, 1)
CONTEXT, FACET = 7, "summary"


def _v(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(table(spark, d, "enliterator_visits"), *columns)


def _c(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(table(spark, d, "enliterator_claims"), *columns)


def _a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enliterator_audits").dropDuplicates(["id"])


def _m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enliterator_context_memberships").groupBy("context_id", "member_type", "member_id").agg(F.min("created_at").alias("created_at"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enliterator_contexts")


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Proposed keys, read out of the event stream."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") % 25
    early = F.col("ts") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    status = F.when(k < 10, "pending").when(k < 15, F.when(early, "approved").otherwise("pending")).when(k < 22, "mapped").otherwise("rejected")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.lit("User").alias("tendable_type"),
        F.col("user_id").cast("string").alias("tendable_id"),
        F.col("event_type").alias("facet"),
        F.concat(F.lit("term_"), k.cast("string")).alias("proposed_key"),
        status.alias("status"),
        F.when(k.between(15, 21), F.concat(F.lit("term_"), (10 + k % 5).cast("string"))).alias("mapped_to"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WITH = f"""WITH v AS MATERIALIZED {_RECORDS.format("enliterator_visits")},
c AS MATERIALIZED {_RECORDS.format("enliterator_claims")},
a AS MATERIALIZED (SELECT DISTINCT * FROM enliterator_audits),
m AS MATERIALIZED (SELECT context_id, member_type, member_id, min(created_at) AS created_at FROM enliterator_context_memberships GROUP BY 1, 2, 3),
done AS (SELECT * FROM v WHERE status = 'succeeded' AND applied),
lively AS (SELECT * FROM c WHERE superseded_by_id IS NULL AND coalesce(status, '') <> 'superseded'),
inst AS (SELECT * FROM a WHERE source IN ('examiner', 'human')),
eff AS (SELECT claim_id, source, verdict FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY source = 'human' DESC, created_at DESC, id DESC) AS r FROM inst) WHERE r = 1),
up AS (SELECT x.id AS context_id, x.id AS ancestor_id, 0::BIGINT AS depth FROM enliterator_contexts x
  UNION ALL SELECT x.id, y.id, 1 FROM enliterator_contexts x JOIN enliterator_contexts y ON x.parent_id = y.id
  UNION ALL SELECT x.id, z.id, 2 FROM enliterator_contexts x JOIN enliterator_contexts y ON x.parent_id = y.id JOIN enliterator_contexts z ON y.parent_id = z.id
  UNION ALL SELECT x.id, w.id, 3 FROM enliterator_contexts x JOIN enliterator_contexts y ON x.parent_id = y.id JOIN enliterator_contexts z ON y.parent_id = z.id JOIN enliterator_contexts w ON z.parent_id = w.id),
s AS (SELECT event_id AS id, 'User' AS tendable_type, user_id::VARCHAR AS tendable_id, event_type AS facet, 'term_' || (k % 25) AS proposed_key,
  CASE WHEN k % 25 < 10 THEN 'pending' WHEN k % 25 < 15 THEN CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'approved' ELSE 'pending' END WHEN k % 25 < 22 THEN 'mapped' ELSE 'rejected' END AS status,
  CASE WHEN k % 25 BETWEEN 15 AND 21 THEN 'term_' || (10 + k % 25 % 5) END AS mapped_to, ts AS created_at, ts AS updated_at
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events)),
told AS (SELECT * FROM lively WHERE visit_id IS NOT NULL OR attributed_to LIKE 'human%'),
item AS (SELECT id, tendable_type, tendable_id, key, confidence, created_at, value::JSON AS x, false AS nested FROM told WHERE json_type(value::JSON) <> 'ARRAY'
  UNION ALL SELECT id, tendable_type, tendable_id, key, confidence, created_at, unnest(json_extract(value::JSON, '$[*]')), true FROM told WHERE json_type(value::JSON) = 'ARRAY'),
headed AS (SELECT DISTINCT tendable_type, tendable_id, key, x->>'$' AS term FROM item
  WHERE json_type(x) = 'VARCHAR' AND length(x->>'$') <= 90 AND trim(regexp_replace(x->>'$', '\\s', ' ', 'g')) <> ''
  AND NOT regexp_matches(key, '(^|_)(number|no|id|code|doi|isbn|issn|identifier)(_|$)') AND NOT regexp_matches(key, '^charter_')),
named AS (SELECT * FROM (SELECT tendable_type || '/' || tendable_id AS node, key, NOT nested AND json_type(x) = 'VARCHAR' AS plain, confidence, created_at AS seen_at, regexp_replace(CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$'
    WHEN 'OBJECT' THEN CASE WHEN json_type(coalesce(x->'$.designation', x->'$.name')) = 'VARCHAR' THEN coalesce(x->>'$.designation', x->>'$.name') END END, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS term FROM item)
  WHERE length(term) BETWEEN 1 AND 90),
ident AS (SELECT lower(term) AS term, min(node) AS node FROM named WHERE plain AND (regexp_matches(key, '(^|_)(number|no|id|code|doi|isbn|issn|identifier)(_|$)') OR key = 'title') GROUP BY 1 HAVING min(node) = max(node)),
edge0 AS (SELECT n.node AS s, coalesce(i.node, 'term/' || lower(n.term)) AS t, n.key, n.confidence AS weight, n.seen_at FROM named n LEFT JOIN ident i ON i.term = lower(n.term)
  WHERE NOT regexp_matches(n.key, '(^|_)(number|no|id|code|doi|isbn|issn|identifier)(_|$)') AND n.key <> 'title'
  UNION ALL SELECT member_type || '/' || member_id, 'context/' || context_id, 'in-context', 1.0, created_at FROM m),
edges AS MATERIALIZED (SELECT s, t, key, max(weight) AS weight, min(seen_at) AS seen_at, CASE WHEN key = 'in-context' THEN 'context'
  WHEN regexp_matches(key, 'cited|citation|bibliograph|reference|source|supersed|related_(report|work)|works?$') THEN 'citation'
  WHEN regexp_matches(key, '(^|_)(number|no|id|code|doi|isbn|issn|identifier)(_|$)|authority|authorized|control|lccn|call_number|classification') THEN 'authority'
  WHEN regexp_matches(key, 'advisor|author|agency|agencies|department|office|committee|sponsor|witness|person|actor|organization|institution') THEN 'agent'
  WHEN regexp_matches(key, 'subject|keyword|index_terms|topic|theme|cluster|tag|issue|domain') THEN 'subject'
  WHEN regexp_matches(key, 'evidence|finding|method|basis|quote|passage|excerpt|indicator|risk|rationale') THEN 'evidence' ELSE 'other' END AS category FROM edge0 WHERE s <> t GROUP BY s, t, key),
degree AS (SELECT node, count(*) AS degree, count(DISTINCT category) AS categories FROM (SELECT s AS node, category FROM edges UNION ALL SELECT t, category FROM edges) GROUP BY node)
"""


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _WITH + sql
        return f

    return add


_TIER = "CASE WHEN trim(coalesce({0}, '')) = '' THEN 'unknown' ELSE {0} END"


@_query(
    f"""SELECT coalesce(v.facet, 'host') AS facet, {_TIER.format("c.tier")} AS tier, count(*) AS audited,
    count(*) FILTER (c.superseded_by_id IS NULL AND coalesce(c.status, '') <> 'superseded') AS live,
    count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'contradicted') AS contradicted,
    count(*) FILTER (verdict = 'unverifiable') AS unverifiable,
    round(count(*) FILTER (verdict = 'supported') / nullif(count(*) FILTER (verdict <> 'unverifiable'), 0), 3) AS supported_rate
    FROM eff JOIN c ON c.id = eff.claim_id LEFT JOIN v ON v.id = c.visit_id GROUP BY 1, 2"""
)
def accuracy(spark, d):
    return audits.accuracy(_a(spark, d), _c(spark, d, "visit_id", "tier", "status", "superseded_by_id"), _v(spark, d, "facet"))


@_query("SELECT claim_id, source, verdict FROM eff")
def effective_verdict(spark, d):
    return audits.effective(_a(spark, d))


_PAIRS = """, pairs AS (SELECT claim_id, max_by(verdict, (created_at, id)) FILTER (source = 'examiner') AS examiner, max_by(verdict, (created_at, id)) FILTER (source = 'human') AS human
  FROM inst GROUP BY 1), usable AS (SELECT * FROM pairs WHERE examiner IS NOT NULL AND human IS NOT NULL AND examiner <> 'unverifiable' AND human <> 'unverifiable')"""


@_query(
    _PAIRS
    + """SELECT count(*) AS overlaps, count(*) FILTER ((examiner = 'supported') = (human = 'supported')) AS agreements, count(*) FILTER (examiner = 'supported') AS examiner_supported,
    count(*) FILTER (examiner = 'supported' AND human <> 'supported') AS overruled_supported,
    CASE WHEN count(*) >= 10 THEN round(count(*) FILTER ((examiner = 'supported') = (human = 'supported')) / count(*), 3) END AS rate FROM usable"""
)
def anchor_agreement(spark, d):
    return audits.agreement(_a(spark, d))


@_query(_PAIRS + "SELECT examiner, human, count(*) AS n FROM usable GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return audits.confusion(_a(spark, d))


@_query(
    """, p AS (SELECT c.id AS claim_id, v.facet, coalesce(c.tier, 'unknown') AS tier, md5(c.id::VARCHAR) AS draw FROM lively c JOIN v ON v.id = c.visit_id
      WHERE NOT coalesce(locked, false) AND c.id NOT IN (SELECT claim_id FROM inst)),
    r AS (SELECT *, row_number() OVER (PARTITION BY facet, tier ORDER BY draw, claim_id) AS place FROM p)
    SELECT claim_id, facet, tier, place::INT AS place FROM r ORDER BY place, draw, claim_id LIMIT 60"""
)
def stratified_sample(spark, d):
    return audits.sample(_c(spark, d, "superseded_by_id", "status", "locked", "visit_id", "tier"), _a(spark, d), _v(spark, d, "facet"), 60)


@_query(
    """, l AS (SELECT claim_id, max_by(verdict, (created_at, id)) AS verdict, max((created_at, id)) AS seen_at FROM a WHERE source <> 'human' AND claim_id NOT IN (SELECT claim_id FROM a WHERE source = 'human') GROUP BY 1)
    SELECT claim_id, verdict FROM (SELECT claim_id, verdict FROM l WHERE verdict <> 'supported' ORDER BY verdict = 'unverifiable', seen_at DESC, claim_id LIMIT 20)
    UNION ALL SELECT claim_id, verdict FROM (SELECT claim_id, verdict FROM l WHERE verdict = 'supported' ORDER BY seen_at DESC, claim_id LIMIT 10)"""
)
def review_queue(spark, d):
    return audits.review_queue(_a(spark, d), 30)


@_query(
    """SELECT facet, count(*) AS total, count(*) FILTER (escalation_step > 0) AS escalated, count(*) FILTER (status = 'succeeded' AND applied) AS final_total,
    count(*) FILTER (status = 'succeeded' AND applied AND coalesce(n_added, 0) + coalesce(n_updated, 0) + coalesce(n_deleted, 0) = 0) AS empty_final,
    round(count(*) FILTER (escalation_step > 0) / count(*), 3) AS escalation_rate,
    coalesce(round(count(*) FILTER (status = 'succeeded' AND applied AND coalesce(n_added, 0) + coalesce(n_updated, 0) + coalesce(n_deleted, 0) = 0) / nullif(count(*) FILTER (status = 'succeeded' AND applied), 0), 3), 0.0) AS empty_final_rate
    FROM v GROUP BY facet"""
)
def report_summary(spark, d):
    return visits.report(_v(spark, d, "facet", "status", "applied", "escalation_step", "n_added", "n_updated", "n_deleted"))


_BIN = "CASE WHEN confidence IS NULL THEN 'nil' WHEN confidence < 0.2 THEN '0.0-0.2' WHEN confidence < 0.4 THEN '0.2-0.4' WHEN confidence < 0.6 THEN '0.4-0.6' WHEN confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"


@_query(
    f""", x AS (SELECT facet, 'status' AS dimension, status AS label FROM v UNION ALL SELECT facet, 'model', {_TIER.format("model")} FROM v
    UNION ALL SELECT facet, 'tier', {_TIER.format("tier")} FROM v UNION ALL SELECT facet, 'confidence', {_BIN} FROM v UNION ALL SELECT facet, 'reason', {_TIER.format("reason")} FROM v)
    SELECT facet, dimension, label, count(*) AS n FROM x GROUP BY 1, 2, 3"""
)
def report_mix(spark, d):
    rows = _v(spark, d, "facet", "status", "model", "tier", "confidence", "reason")
    return visits.mix(rows, {"status": F.col("status"), "model": visits.named("model"), "tier": visits.named("tier"), "confidence": visits.confidence_bin(F.col("confidence")), "reason": visits.named("reason")})


@_query(
    f""", x AS (SELECT facet, {_TIER.format("tier")} AS tier, coalesce(tokens_input, 0) AS i, coalesce(tokens_output, 0) AS o, coalesce(tokens_total, 0) AS t FROM v)
    SELECT facet, tier, sum(i)::BIGINT AS tokens_input, sum(o)::BIGINT AS tokens_output, sum(t)::BIGINT AS tokens_total FROM x GROUP BY GROUPING SETS ((facet, tier), (facet))"""
)
def spend_by_facet_tier(spark, d):
    return visits.spend(_v(spark, d, "facet", "tier", "tokens_input", "tokens_output", "tokens_total"))


@_query(
    """, g AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY created_at DESC, id DESC) AS r, row_number() OVER (ORDER BY created_at DESC, id DESC) AS q FROM v WHERE status = 'succeeded'),
    e AS (SELECT facet, CASE WHEN count(*) FILTER (applied) > 0 AND sum(coalesce(tokens_total, 0)) > 0 THEN greatest(sum(coalesce(tokens_total, 0))::BIGINT // count(*) FILTER (applied), 1) END AS est FROM g WHERE r <= 50 GROUP BY 1),
    w AS (SELECT CASE WHEN count(*) FILTER (applied) > 0 AND sum(coalesce(tokens_total, 0)) > 0 THEN greatest(sum(coalesce(tokens_total, 0))::BIGINT // count(*) FILTER (applied), 1) END AS est FROM g WHERE q <= 50)
    SELECT f.facet, coalesce(e.est, (SELECT est FROM w), 4000)::BIGINT AS est FROM (SELECT DISTINCT facet FROM v) f LEFT JOIN e ON e.facet IS NOT DISTINCT FROM f.facet"""
)
def est_tokens(spark, d):
    return visits.estimates(_v(spark, d, "facet", "status", "applied", "created_at", "tokens_total"))


@_query("SELECT tendable_type, tendable_id, facet, max(finished_at) AS last_finished FROM done GROUP BY 1, 2, 3")
def last_tended(spark, d):
    return visits.last_tended(_v(spark, d, *RECORD, "facet", "status", "applied", "finished_at"), [*RECORD, "facet"])


_FRONTIER = "SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM done v WHERE v.facet = 'summary' AND v.context_id = m.context_id AND v.tendable_type = m.member_type AND v.tendable_id = m.member_id)"


@_query(_FRONTIER + " AND NOT EXISTS (SELECT 1 FROM v f WHERE f.status = 'failed' AND f.created_at > TIMESTAMP '2031-06-01' AND f.facet = 'summary' AND f.context_id = m.context_id AND f.tendable_type = m.member_type AND f.tendable_id = m.member_id)")
def frontier_fetch(spark, d):
    return visits.frontier(_m(spark, d), _v(spark, d, *RECORD, "facet", "context_id", "status", "applied", "created_at"), FACET, MONTH)


@_query(f"SELECT context_id, count(*) AS waiting FROM ({_FRONTIER}) GROUP BY 1")
def frontier_count(spark, d):
    left = visits.frontier(_m(spark, d), _v(spark, d, *RECORD, "facet", "context_id", "status", "applied", "created_at"), FACET)
    return left.groupBy("context_id").agg(F.count("*").alias("waiting"))


#: The host records are those that any table names; the tables of the hosts themselves are not among the data.
_LANES = """, ho AS (SELECT tendable_type, tendable_id FROM v UNION SELECT tendable_type, tendable_id FROM c UNION SELECT tendable_type, tendable_id FROM documents UNION SELECT member_type, member_id FROM m),
    wa AS (SELECT f.facet, w.* FROM (SELECT DISTINCT facet FROM v) f, (SELECT context_id, member_type, member_id, created_at FROM m UNION ALL SELECT NULL, tendable_type, tendable_id, NULL FROM ho WHERE tendable_type NOT LIKE '%::%' AND tendable_id IS NOT NULL) w),
    fr AS (SELECT * FROM wa WHERE NOT EXISTS (SELECT 1 FROM done v WHERE v.facet IS NOT DISTINCT FROM wa.facet AND v.context_id IS NOT DISTINCT FROM wa.context_id AND v.tendable_type = wa.member_type AND v.tendable_id = wa.member_id))
"""


def _lanes(spark, d):
    log = _v(spark, d, *RECORD, "facet", "context_id", "status", "applied", "created_at")
    members = _m(spark, d)
    named = [log, _c(spark, d, *RECORD), table(spark, d, "documents"), members.select(F.col("member_type").alias("tendable_type"), F.col("member_id").alias("tendable_id"))]
    hosts = named[0].select(*RECORD)
    for rows in named[1:]:
        hosts = hosts.unionByName(rows.select(*RECORD))
    hosts = hosts.where("tendable_type NOT LIKE '%::%' AND tendable_id IS NOT NULL").distinct()
    return visits.lanes(members, log.select("facet").distinct(), hosts), log


@_query(
    _LANES
    + """SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM v f WHERE f.status = 'failed' AND f.created_at > TIMESTAMP '2031-06-01'
    AND f.facet IS NOT DISTINCT FROM fr.facet AND f.context_id IS NOT DISTINCT FROM fr.context_id AND f.tendable_type = fr.member_type AND f.tendable_id = fr.member_id)"""
)
def frontier_lanes_fetch(spark, d):
    return visits.frontier_lanes(*_lanes(spark, d), MONTH)


@_query(_LANES + "SELECT facet, context_id, count(*) AS waiting FROM fr GROUP BY 1, 2")
def frontier_lanes_count(spark, d):
    return visits.frontier_lanes(*_lanes(spark, d)).groupBy("facet", "context_id").agg(F.count("*").alias("waiting"))


@_query(
    """, l AS (SELECT *, row_number() OVER (PARTITION BY context_id, facet ORDER BY created_at DESC, id DESC) - 1 AS later FROM done WHERE context_id IS NOT NULL AND created_at IS NOT NULL)
    SELECT context_id, facet, tendable_type, tendable_id, min(later)::BIGINT AS behind FROM l GROUP BY 1, 2, 3, 4 HAVING min(later) >= 20 AND max(created_at) < TIMESTAMP '2031-06-01'"""
)
def neighborhood(spark, d):
    return visits.neighborhood(_v(spark, d, *RECORD, "facet", "context_id", "status", "applied", "created_at"), 20, MONTH)


@_query("SELECT context_id, facet, tendable_type, tendable_id, max(started_at) AS last_started FROM done GROUP BY 1, 2, 3, 4 HAVING max(started_at) < TIMESTAMP '2030-06-01'")
def sweep(spark, d):
    return visits.stale(_v(spark, d, *RECORD, "facet", "context_id", "status", "applied", "started_at"), THEN)


@_query(
    """, n AS (SELECT tendable_type, tendable_id, max(captured_at) AS changed_at FROM documents GROUP BY 1, 2), l AS (SELECT tendable_type, tendable_id, facet, max(started_at) AS last_started FROM done GROUP BY 1, 2, 3)
    SELECT l.*, n.changed_at FROM l JOIN n USING (tendable_type, tendable_id) WHERE n.changed_at > l.last_started"""
)
def source_change(spark, d):
    changed = table(spark, d, "documents").select(*RECORD, "captured_at")
    return visits.source_changes(_v(spark, d, *RECORD, "facet", "status", "applied", "started_at"), changed, "captured_at").select(*RECORD, "facet", "last_started", "changed_at")


@_query("SELECT created_at::DATE AS day, count(*) AS visits, count(*) FILTER (status = 'failed') AS failed, coalesce(sum(tokens_total), 0)::BIGINT AS tokens FROM v WHERE created_at IS NOT NULL GROUP BY 1")
def visits_per_day(spark, d):
    return visits.per_day(_v(spark, d, "created_at", "status", "tokens_total"))


@_query(
    """, b AS (SELECT heartbeat_id, min(created_at) AS seen_at FROM v WHERE heartbeat_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 8)
    SELECT count(*) AS beats, CASE WHEN count(*) > 1 THEN round((epoch_us(max(seen_at)) - epoch_us(min(seen_at))) / 3.6e9 / (count(*) - 1), 3) END AS mean_gap_hours FROM b"""
)
def cadence(spark, d):
    return visits.cadence(_v(spark, d, "heartbeat_id", "created_at"))


@_query(
    """, n AS (SELECT * FROM done ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 40)
    SELECT tendable_type, tendable_id, max(created_at) AS last_at FROM n GROUP BY 1, 2 ORDER BY 3 DESC NULLS LAST, 1, 2 LIMIT 8"""
)
def recently_tended(spark, d):
    return visits.recently_tended(_v(spark, d, *RECORD, "status", "applied", "created_at"))


@_query(
    """, n AS (SELECT a.id, b.id AS parent FROM v a LEFT JOIN v b ON a.escalated_from_id = b.id),
    w AS (WITH RECURSIVE r(id, top, steps) USING KEY (id) AS (SELECT id, id, 0::BIGINT FROM n UNION SELECT r.id, n.parent, r.steps + 1 FROM r JOIN n ON n.id = r.top WHERE n.parent IS NOT NULL AND r.steps < 400) SELECT * FROM r),
    e AS (SELECT id, CASE WHEN steps >= 400 THEN id ELSE top END AS root_id, CASE WHEN steps >= 400 THEN 0 ELSE steps END AS depth FROM w)
    SELECT e.root_id, count(*) AS visits, max(depth)::BIGINT AS steps, coalesce(sum(v.tokens_total), 0)::BIGINT AS tokens FROM e JOIN v ON v.id = e.id GROUP BY 1"""
)
def escalation_chain(spark, d):
    rows = _v(spark, d, "escalated_from_id", "tokens_total")
    known = rows.select("id", F.col("escalated_from_id").alias("parent")).alias("l").join(rows.select(F.col("id").alias("there")).alias("t"), F.expr("l.parent = t.there"), "left_semi")
    return visits.chain_tokens(rows, hierarchy.forest(known))


@_query(
    """, k AS (SELECT *, row_number() OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY created_at DESC, id DESC) AS back FROM done),
    p AS (SELECT *, max(back) OVER (PARTITION BY tendable_type, tendable_id, facet) - back + 1 AS pass FROM k WHERE back <= 50)
    SELECT pass, count(*) AS visits, sum(coalesce(n_added, 0))::BIGINT AS added, sum(coalesce(n_updated, 0))::BIGINT AS updated, sum(coalesce(n_deleted, 0))::BIGINT AS deleted, sum(coalesce(n_noop, 0))::BIGINT AS noop,
    round(avg(confidence), 4) AS mean_confidence,
    CASE WHEN sum(coalesce(n_added, 0) + coalesce(n_updated, 0) + coalesce(n_deleted, 0) + coalesce(n_noop, 0)) > 0 THEN round(sum(coalesce(n_added, 0)) / sum(coalesce(n_added, 0) + coalesce(n_updated, 0) + coalesce(n_deleted, 0) + coalesce(n_noop, 0)), 6) END AS novel_rate
    FROM p GROUP BY 1"""
)
def compounding(spark, d):
    return visits.passes(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at", "confidence", "n_added", "n_updated", "n_deleted", "n_noop"))


@_query("SELECT id, tendable_type, tendable_id, context_id, key, value FROM told")
def live_claims(spark, d):
    rows = _c(spark, d, *RECORD, "context_id", "key", "value", "superseded_by_id", "status", "visit_id", "attributed_to")
    return rows.where(claims.live() & claims.understanding()).select("id", *RECORD, "context_id", "key", "value")


@_query("SELECT * FROM up")
def context_closure(spark, d):
    return scope.closure(_contexts(spark, d))


@_query("SELECT id, tendable_type, tendable_id, context_id, key FROM lively WHERE context_id IS NULL OR context_id IN (SELECT ancestor_id FROM up WHERE up.context_id = 7)")
def scoped_claims(spark, d):
    rows = _c(spark, d, *RECORD, "context_id", "key", "superseded_by_id", "status").where(claims.live())
    return scope.cumulative(rows, scope.closure(_contexts(spark, d)), CONTEXT).select("id", *RECORD, "context_id", "key")


@_query("SELECT id, tendable_type, tendable_id, key FROM lively c WHERE EXISTS (SELECT 1 FROM m WHERE m.context_id = 1 AND m.member_type = c.tendable_type AND m.member_id = c.tendable_id)")
def member_claims(spark, d):
    rows = _c(spark, d, *RECORD, "key", "superseded_by_id", "status").where(claims.live())
    return scope.members(rows, _m(spark, d), 1).select("id", *RECORD, "key")


@_query("SELECT facet, count(*) AS visits FROM v WHERE context_id IS NULL GROUP BY 1")
def root_lanes(spark, d):
    return _v(spark, d, "facet", "context_id").where(scope.exact(None)).groupBy("facet").agg(F.count("*").alias("visits"))


@_query(
    """, x AS (SELECT context_id, max(depth) AS depth FROM up GROUP BY 1), r AS (SELECT m.*, row_number() OVER (PARTITION BY member_type, member_id ORDER BY coalesce(x.depth, 0) DESC, m.context_id) AS n FROM m LEFT JOIN x USING (context_id))
    SELECT member_type, member_id, context_id FROM r WHERE n = 1"""
)
def dominant_context(spark, d):
    return scope.deepest(_m(spark, d), scope.closure(_contexts(spark, d))).select("member_type", "member_id", "context_id")


@_query(
    """SELECT c.id, CASE WHEN c.status = 'superseded' THEN 'superseded' WHEN e.source = 'human' AND e.verdict = 'supported' THEN 'human_verified' WHEN e.verdict = 'supported' THEN 'examiner_supported'
    WHEN e.verdict IN ('unsupported', 'contradicted') THEN 'contradicted' WHEN c.locked AND c.attributed_to LIKE 'human%' THEN 'human_verified' ELSE c.status END AS warrant FROM c LEFT JOIN eff e ON e.claim_id = c.id"""
)
def warrant(spark, d):
    return claims.warrant(_c(spark, d, "status", "locked", "attributed_to"), _a(spark, d)).select("id", "warrant")


_STATE = """SELECT c.* FROM c LEFT JOIN c s ON s.id = c.superseded_by_id WHERE c.created_at <= {0} AND CASE WHEN c.superseded_by_id IS NOT NULL THEN s.id IS NULL OR s.created_at > {0}
    WHEN c.status = 'superseded' THEN c.updated_at > {0} ELSE true END"""


@_query(f"SELECT id, tendable_type, tendable_id, key FROM ({_STATE.format('''TIMESTAMP '2030-06-01' ''')})")
def state_at(spark, d):
    return claims.state_at(_c(spark, d, *RECORD, "key", "superseded_by_id", "status", "created_at"), THEN).select("id", *RECORD, "key")


@_query(
    f""", b AS (SELECT tendable_type, tendable_id, key, max_by(id, (created_at, id)) AS id, max_by({{'v': value}}, (created_at, id)).v AS value FROM ({_STATE.format('''TIMESTAMP '2030-06-01' ''')}) GROUP BY 1, 2, 3),
    n AS (SELECT tendable_type, tendable_id, key, max_by(id, (created_at, id)) AS id, max_by({{'v': value}}, (created_at, id)).v AS value FROM ({_STATE.format('''TIMESTAMP '2031-06-01' ''')}) GROUP BY 1, 2, 3)
    SELECT coalesce(b.tendable_type, n.tendable_type) AS tendable_type, coalesce(b.tendable_id, n.tendable_id) AS tendable_id, coalesce(b.key, n.key) AS key,
    CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' ELSE 'changed' END AS kind, b.value AS from_value, n.value AS to_value
    FROM b FULL JOIN n ON b.tendable_type = n.tendable_type AND b.tendable_id = n.tendable_id AND b.key = n.key WHERE b.id IS NULL OR n.id IS NULL OR b.id <> n.id OR b.value IS DISTINCT FROM n.value"""
)
def timeline_diff(spark, d):
    rows = _c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status", "created_at")
    return claims.state_diff(claims.state_at(rows, THEN), claims.state_at(rows, MONTH))


#: What each applied visit left: the claims of its facet that live a millisecond before the next later one, at the end of the log for the last.
_TIMELINE = """, t AS (SELECT *, row_number() OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY created_at, id) AS step,
      min(created_at) OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY epoch_us(created_at) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - INTERVAL 1 MILLISECOND AS until FROM done WHERE created_at IS NOT NULL),
    o AS (SELECT c.*, v.facet, CASE WHEN c.superseded_by_id IS NOT NULL THEN CASE WHEN s.id IS NULL THEN TIMESTAMP 'infinity' ELSE s.created_at END WHEN c.status = 'superseded' THEN c.updated_at ELSE TIMESTAMP 'infinity' END AS ended
      FROM c JOIN v ON v.id = c.visit_id AND v.tendable_type IS NOT DISTINCT FROM c.tendable_type AND v.tendable_id IS NOT DISTINCT FROM c.tendable_id LEFT JOIN c s ON s.id = c.superseded_by_id),
    st AS MATERIALIZED (SELECT t.tendable_type, t.tendable_id, t.facet, t.step, t.id AS visit_id, o.key, arg_max({'id': o.id, 'value': o.value}, (o.created_at, o.id)) AS c FROM t
      JOIN o ON o.tendable_type IS NOT DISTINCT FROM t.tendable_type AND o.tendable_id IS NOT DISTINCT FROM t.tendable_id AND o.facet IS NOT DISTINCT FROM t.facet
      WHERE (t.until IS NULL OR o.created_at <= t.until) AND (o.ended = TIMESTAMP 'infinity' OR t.until IS NOT NULL AND o.ended > t.until) AND o.created_at IS NOT NULL GROUP BY ALL),
    pr AS (SELECT n.tendable_type, n.tendable_id, n.facet, n.id AS visit_id, n.step, p.id AS prior_id FROM t n JOIN t p ON p.tendable_type IS NOT DISTINCT FROM n.tendable_type AND p.tendable_id IS NOT DISTINCT FROM n.tendable_id AND p.facet IS NOT DISTINCT FROM n.facet AND p.step = n.step - 1),
    was AS (SELECT pr.visit_id, st.key, st.c FROM pr JOIN st ON st.visit_id = pr.prior_id), now AS (SELECT st.visit_id, st.key, st.c FROM st WHERE st.step > 1),
    df AS (SELECT coalesce(was.visit_id, now.visit_id) AS visit_id, coalesce(was.key, now.key) AS key, CASE WHEN was.c IS NULL THEN 'added' WHEN now.c IS NULL THEN 'deleted' ELSE 'changed' END AS kind,
      was.c.id AS from_id, now.c.id AS to_id, was.c.value AS from_value, now.c.value AS to_value FROM was FULL JOIN now ON was.visit_id = now.visit_id AND was.key IS NOT DISTINCT FROM now.key
      WHERE was.c IS NULL OR now.c IS NULL OR was.c.id <> now.c.id)
"""


@_query(_TIMELINE + "SELECT v.tendable_type, v.tendable_id, v.facet, df.* FROM df JOIN v ON v.id = df.visit_id")
def timeline(spark, d):
    rows = _c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status", "visit_id", "created_at")
    return trajectory.timeline(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at"), rows)


@_query(
    _TIMELINE
    + """, x AS (SELECT visit_id, key, regexp_replace(lower(coalesce(CASE WHEN json_type(from_value::JSON) = 'VARCHAR' THEN from_value::JSON->>'$' ELSE from_value END, 'null')), '\\s+', ' ', 'g') AS a, regexp_replace(lower(coalesce(CASE WHEN json_type(to_value::JSON) = 'VARCHAR' THEN to_value::JSON->>'$' ELSE to_value END, 'null')), '\\s+', ' ', 'g') AS b, coalesce(CASE WHEN json_type(from_value::JSON) = 'VARCHAR' THEN from_value::JSON->>'$' ELSE from_value END, 'null') = coalesce(CASE WHEN json_type(to_value::JSON) = 'VARCHAR' THEN to_value::JSON->>'$' ELSE to_value END, 'null') AS same FROM df WHERE kind = 'changed'),
    g AS (SELECT visit_id, key, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g, 1 AS l, 0 AS r FROM x UNION ALL SELECT visit_id, key, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))), 0, 1 FROM x),
    di AS (SELECT visit_id, key, 2.0 * sum(least(l, r)) / sum(l + r) AS dice FROM (SELECT visit_id, key, g, sum(l) AS l, sum(r) AS r FROM g GROUP BY ALL) GROUP BY ALL),
    ch AS (SELECT x.visit_id, count(*) AS n FROM x LEFT JOIN di ON di.visit_id = x.visit_id AND di.key IS NOT DISTINCT FROM x.key WHERE x.same OR di.dice > 0.85 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY tendable_type, tendable_id, facet ORDER BY created_at DESC, id DESC) AS back FROM done),
    p AS (SELECT *, max(back) OVER (PARTITION BY tendable_type, tendable_id, facet) - back + 1 AS pass FROM k WHERE back <= 50)
    SELECT pass, sum(coalesce(n_updated, 0))::BIGINT AS updated, coalesce(sum(ch.n) FILTER (pass > 1), 0)::BIGINT AS churned,
    CASE WHEN sum(coalesce(n_updated, 0)) > 0 THEN round(coalesce(sum(ch.n) FILTER (pass > 1), 0) / sum(coalesce(n_updated, 0)), 3) END AS churn_rate FROM p LEFT JOIN ch ON ch.visit_id = p.id GROUP BY 1"""
)
def compounding_churn(spark, d):
    rows = _c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status", "visit_id", "created_at")
    return trajectory.compounding(_v(spark, d, *RECORD, "facet", "status", "applied", "created_at", "n_updated"), rows)


@_query("SELECT c.id, s.id AS next_id, c.key FROM c JOIN c s ON s.id = c.superseded_by_id AND s.key = c.key WHERE c.value IS NOT NULL AND s.value IS NOT NULL")
def successions(spark, d):
    return claims.successions(_c(spark, d, "key", "value", "superseded_by_id")).select("id", "next_id", "key")


_PLAIN = "CASE WHEN json_type({0}.value::JSON) = 'VARCHAR' THEN {0}.value::JSON->>'$' ELSE {0}.value END"


@_query(
    f""", x AS (SELECT c.id, s.id AS next_id, c.key, {_PLAIN.format("c")} AS a, {_PLAIN.format("s")} AS b FROM c JOIN c s ON s.id = c.superseded_by_id AND s.key = c.key WHERE c.value IS NOT NULL AND s.value IS NOT NULL),
    y AS (SELECT *, regexp_replace(lower(a), '\\s+', ' ', 'g') AS l, regexp_replace(lower(b), '\\s+', ' ', 'g') AS r FROM x),
    g AS (SELECT id, unnest(list_transform(range(1, length(l)), lambda i: substr(l, i, 2))) AS g, 1 AS l, 0 AS r FROM y UNION ALL SELECT id, unnest(list_transform(range(1, length(r)), lambda i: substr(r, i, 2))), 0, 1 FROM y),
    di AS (SELECT id, 2.0 * sum(least(l, r)) / sum(l + r) AS dice FROM (SELECT id, g, sum(l) AS l, sum(r) AS r FROM g GROUP BY ALL) GROUP BY id),
    z AS (SELECT y.id, next_id, key, CASE WHEN a = b THEN 1.0::DOUBLE ELSE coalesce(dice, 0.0)::DOUBLE END AS similarity FROM y LEFT JOIN di ON di.id = y.id)
    SELECT id, next_id, key, round(similarity, 6) AS similarity, similarity > 0.85 AS churn FROM z"""
)
def churn(spark, d):
    """Every succession's similarity."""
    return claims.successions(_c(spark, d, "key", "value", "superseded_by_id")).select("id", "next_id", "key", F.round("similarity", 6).alias("similarity"), "churn")


@_query("SELECT 'members' AS measure, count(*) AS n FROM (SELECT DISTINCT member_type, member_id FROM m) UNION ALL SELECT 'tended', count(*) FROM (SELECT DISTINCT tendable_type, tendable_id FROM done) UNION ALL SELECT 'live_claims', count(*) FROM lively UNION ALL SELECT 'keys', count(DISTINCT key) FROM told")
def catalog_overview(spark, d):
    return catalog.overview(_c(spark, d, "key", "superseded_by_id", "status", "visit_id", "attributed_to"), _m(spark, d), _v(spark, d, *RECORD, "status", "applied"))


@_query(
    """, t AS (SELECT key, term, count(*) AS records FROM headed GROUP BY 1, 2), k AS (SELECT key, max(records) AS most, count(*) AS n_terms FROM t GROUP BY 1),
    h AS (SELECT key, count(*) AS key_records FROM (SELECT DISTINCT key, tendable_type, tendable_id FROM headed) GROUP BY 1),
    w AS (SELECT key FROM k JOIN h USING (key) WHERE most > 1 OR n_terms <= 10 ORDER BY key_records DESC, key LIMIT 8),
    r AS (SELECT t.*, row_number() OVER (PARTITION BY key ORDER BY records DESC, term) AS place FROM t JOIN w USING (key))
    SELECT key, term, records, place::INT AS place FROM r WHERE place <= 10"""
)
def headings(spark, d):
    return catalog.headings(_c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status", "visit_id", "attributed_to"))


@_query("SELECT tendable_type, tendable_id FROM headed WHERE key = 'subject' AND term = 'public safety'")
def subject(spark, d):
    return catalog.subject(_c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status", "visit_id", "attributed_to"), "subject", "public safety")


@_query("SELECT id, tendable_type, tendable_id FROM lively ORDER BY id DESC LIMIT 24 OFFSET 24")
def accession_page(spark, d):
    rows = _c(spark, d, *RECORD, "superseded_by_id", "status").where(claims.live()).select("id", *RECORD)
    return catalog.page(rows, 2)


@_query("SELECT DISTINCT tendable_type FROM v WHERE tendable_type NOT LIKE '%::%'")
def host_types(spark, d):
    return catalog.host_types(_v(spark, d, "tendable_type"))


@_query(
    """, h AS (SELECT v.facet, l.*, row_number() OVER (PARTITION BY v.facet, l.key ORDER BY l.id) AS n FROM lively l JOIN v ON v.id = l.visit_id)
    SELECT facet, key, count(*) AS live_claims, count(DISTINCT (tendable_type, tendable_id)) AS records, string_agg(coalesce(value, 'null'), ' | ' ORDER BY n) FILTER (n <= 3) AS sample FROM h GROUP BY 1, 2"""
)
def facet_portrait(spark, d):
    return catalog.portrait(_c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status", "visit_id"), _v(spark, d, "facet"))


@_query(
    """, t AS (SELECT tendable_type, tendable_id, count(*) AS live_claims FROM lively GROUP BY 1, 2), r AS (SELECT tendable_type, tendable_id, count(*) AS visits, max(finished_at) AS last_at FROM done GROUP BY 1, 2),
    p AS (SELECT member_type AS tendable_type, member_id AS tendable_id, count(DISTINCT context_id) AS contexts FROM m GROUP BY 1, 2)
    SELECT tendable_type, tendable_id, coalesce(live_claims, 0) AS live_claims, coalesce(visits, 0) AS visits, coalesce(contexts, 0) AS contexts, last_at FROM t FULL JOIN r USING (tendable_type, tendable_id) FULL JOIN p USING (tendable_type, tendable_id)"""
)
def cards(spark, d):
    return catalog.cards(_c(spark, d, *RECORD, "superseded_by_id", "status"), _v(spark, d, *RECORD, "status", "applied", "finished_at"), _m(spark, d))


@_query(
    """SELECT x.id, (SELECT count(*) FROM m WHERE m.context_id = x.id) AS members, (SELECT count(*) FROM lively l WHERE l.context_id = x.id) AS live_claims, (SELECT count(*) FROM done v WHERE v.context_id = x.id) AS visits FROM enliterator_contexts x"""
)
def context_stats(spark, d):
    return catalog.context_stats(_contexts(spark, d), _m(spark, d), _c(spark, d, "context_id", "superseded_by_id", "status"), _v(spark, d, "context_id", "status", "applied"))


@_query(
    """, r AS (SELECT DISTINCT tendable_type, tendable_id FROM v) SELECT tendable_type, tendable_id, round((
    (EXISTS (SELECT 1 FROM lively l WHERE l.tendable_type = r.tendable_type AND l.tendable_id = r.tendable_id))::INT + (EXISTS (SELECT 1 FROM done l WHERE l.tendable_type = r.tendable_type AND l.tendable_id = r.tendable_id))::INT
    + (EXISTS (SELECT 1 FROM m WHERE m.member_type = r.tendable_type AND m.member_id = r.tendable_id))::INT) / 3, 6) AS score FROM r"""
)
def completeness(spark, d):
    read = _v(spark, d, *RECORD, "status", "applied")
    return catalog.completeness(read, _c(spark, d, *RECORD, "superseded_by_id", "status"), read, _m(spark, d))


def _graph(spark, d):
    held = _c(spark, d, *RECORD, "context_id", "key", "value", "confidence", "superseded_by_id", "status", "visit_id", "attributed_to", "created_at")
    return held, graph.edges(held, _m(spark, d))


@_query("SELECT term, node FROM ident")
def entity_index(spark, d):
    return graph.entity_index(_graph(spark, d)[0])


@_query("SELECT s, t, key, category, weight, seen_at FROM edges")
def atlas_edges(spark, d):
    return _graph(spark, d)[1].select("s", "t", "key", "category", "weight", "seen_at")


@_query(
    """SELECT node, CASE WHEN node LIKE 'context/%' THEN 'context' WHEN node LIKE 'term/%' THEN 'entity' ELSE 'record' END AS kind, degree,
    (CASE WHEN node LIKE 'context/%' THEN 100 WHEN node LIKE 'term/%' THEN CASE WHEN degree >= 10 THEN 60 ELSE 0 END WHEN degree >= 10 THEN 80 ELSE 0 END)::BIGINT AS priority FROM degree"""
)
def atlas_nodes(spark, d):
    return graph.nodes(_graph(spark, d)[1])


_OVERVIEW = """, dg AS (SELECT node, degree, CASE WHEN node LIKE 'context/%' THEN 'context' WHEN node LIKE 'term/%' THEN 'entity' ELSE 'record' END AS kind FROM degree),
    dx AS (SELECT context_id, max(depth) AS depth FROM up GROUP BY 1),
    gr AS (SELECT tendable_type || '/' || tendable_id AS node, arg_max(told.context_id, (coalesce(depth, 0), -told.context_id)) AS grp FROM told LEFT JOIN dx ON dx.context_id = told.context_id WHERE told.context_id IS NOT NULL GROUP BY 1),
    rc AS (SELECT dg.node, degree, grp FROM dg LEFT JOIN gr ON gr.node = dg.node WHERE kind = 'record'),
    pg AS (SELECT least(greatest(ceil(130.0 / greatest(count(DISTINCT coalesce(grp, -1)), 1)), 18), 55) AS n FROM rc),
    c1 AS (SELECT node, 1 AS part, node AS a, 0::BIGINT AS b, '' AS z FROM dg WHERE kind = 'context'),
    c2 AS (SELECT node, 2 AS part, coalesce(lpad(grp::VARCHAR, 20, '0'), '~') AS a, r AS b, node AS z FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, node) AS r FROM rc) WHERE r <= (SELECT n FROM pg)),
    rr AS (SELECT e.s, e.t, row_number() OVER (ORDER BY coalesce(nullif(weight, 0), 0.5) DESC, key, e.s, e.t) AS r FROM edges e JOIN dg x ON x.node = e.s AND x.kind = 'record' JOIN dg y ON y.node = e.t AND y.kind = 'record' WHERE category <> 'context'),
    c3 AS (SELECT s AS node, 3 AS part, '' AS a, 2 * r AS b, '' AS z FROM rr WHERE r <= 80 UNION ALL SELECT t, 3, '', 2 * r + 1, '' FROM rr WHERE r <= 80),
    c4 AS (SELECT node, 4 AS part, '' AS a, row_number() OVER (ORDER BY degree DESC, node) AS b, '' AS z FROM dg WHERE kind = 'entity' AND degree >= 2 QUALIFY row_number() OVER (ORDER BY degree DESC, node) <= 70),
    c5 AS (SELECT node, 5 AS part, '' AS a, row_number() OVER (ORDER BY degree DESC, node) AS b, '' AS z FROM dg WHERE kind = 'record'),
    al AS (SELECT node, min((part, a, b, z)) AS place FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5) GROUP BY node),
    kp AS (SELECT node FROM al ORDER BY place LIMIT 240)
"""


def _overview(spark, d):
    held, drawn = _graph(spark, d)
    drawn = stage(drawn).df
    return drawn, graph.overview_nodes(drawn, graph.grouped(held, scope.closure(_contexts(spark, d))))


@_query(_OVERVIEW + "SELECT node FROM kp")
def atlas_overview_nodes(spark, d):
    return _overview(spark, d)[1]


@_query(_OVERVIEW + "SELECT s, t, key, category FROM edges WHERE s IN (SELECT node FROM kp) AND t IN (SELECT node FROM kp) ORDER BY category = 'context', coalesce(nullif(weight, 0), 0.5) DESC, key, s, t LIMIT 420")
def atlas_overview(spark, d):
    return graph.overview(*_overview(spark, d)).select("s", "t", "key", "category")


@_query(", k AS (SELECT node FROM degree ORDER BY degree DESC, node LIMIT 240) SELECT s, t, key FROM edges WHERE s IN (SELECT node FROM k) AND t IN (SELECT node FROM k)")
def atlas_degree_cap(spark, d):
    return graph.capped(_graph(spark, d)[1], 240).select("s", "t", "key")


@_query(
    """, b AS (SELECT s, t FROM edges WHERE s NOT LIKE 'context/%' UNION SELECT t, s FROM edges WHERE t NOT LIKE 'context/%'),
    h1 AS (SELECT DISTINCT t AS node FROM b WHERE s = 'Library/1'), h2 AS (SELECT DISTINCT t AS node FROM b WHERE s IN (SELECT node FROM h1) AND t NOT IN (SELECT node FROM h1) AND t <> 'Library/1'),
    r AS (SELECT 'Library/1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)
    SELECT node, hop FROM r LEFT JOIN degree USING (node) ORDER BY hop, coalesce(degree, 0) DESC, node LIMIT 250"""
)
def atlas_focus(spark, d):
    return graph.focus(_graph(spark, d)[1], "Library/1")


@_query(
    """, n AS (SELECT t AS node FROM edges WHERE s = 'Library/1' UNION ALL SELECT s FROM edges WHERE t = 'Library/1'), c2 AS (SELECT node, count(*) AS links FROM n GROUP BY 1)
    SELECT node, links, degree FROM c2 JOIN degree USING (node) ORDER BY links DESC, degree DESC, node LIMIT 40"""
)
def ego_neighbors(spark, d):
    return graph.neighbours(_graph(spark, d)[1], "Library/1", 40)


@_query(
    """, n AS (SELECT split_part(s, '/', 1) AS kind, key, count(*) AS n FROM edges GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS place FROM n)
    SELECT kind, key, n, place::INT AS place FROM r WHERE place <= 6"""
)
def edge_types(spark, d):
    return graph.edge_types(_graph(spark, d)[1])


@_query("SELECT min(seen_at) AS first_at, max(seen_at) AS last_at FROM edges")
def atlas_time_range(spark, d):
    return graph.time_range(_graph(spark, d)[1])


@_query(
    """, l AS (SELECT key, length(term) AS size, row_number() OVER (PARTITION BY key ORDER BY length(term)) AS r, count(*) OVER (PARTITION BY key) AS n FROM named)
    SELECT key, n AS n_terms, size::INT AS median_length FROM l WHERE r = n // 2 + 1"""
)
def entity_keys(spark, d):
    return graph.entity_keys(_graph(spark, d)[0])


@_query(
    """, k AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents WHERE text IS NOT NULL)
    SELECT id AS doc_id, ordinal::INT AS ordinal, t AS text, coalesce(sum(length(t)) OVER (PARTITION BY id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start,
    sum(length(t)) OVER (PARTITION BY id ORDER BY ordinal)::INT AS char_end, md5(t) AS digest FROM k"""
)
def text_sections(spark, d):
    return sections.sections(table(spark, d, "documents"), "doc_id", "text")


@_query(
    """, x AS (SELECT to_json([tendable_type, tendable_id]) AS record, text, row_number() OVER (PARTITION BY tendable_type, tendable_id ORDER BY captured_at DESC NULLS LAST, doc_id DESC) AS r FROM documents WHERE text IS NOT NULL AND tendable_type IS NOT NULL AND tendable_id IS NOT NULL),
    y AS (SELECT record, r, md5(unnest(string_split(text, chr(10)))) AS digest, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS ordinal FROM x WHERE r <= 2 AND record IN (SELECT record FROM x WHERE r = 2))
    SELECT coalesce(b.record, n.record) AS record, coalesce(b.ordinal, n.ordinal) AS ordinal, CASE WHEN b.record IS NULL THEN 'created' WHEN n.record IS NULL THEN 'deleted' WHEN b.digest <> n.digest THEN 'updated' ELSE 'kept' END AS change
    FROM (SELECT * FROM y WHERE r = 2) b FULL JOIN (SELECT * FROM y WHERE r = 1) n ON b.record = n.record AND b.ordinal = n.ordinal"""
)
def section_changes(spark, d):
    """What the newest text of a record changes in the sections of the text before it."""
    texts = table(spark, d, "documents").where("text IS NOT NULL AND tendable_type IS NOT NULL AND tendable_id IS NOT NULL")
    newest = Window.partitionBy(*RECORD).orderBy(F.col("captured_at").desc_nulls_last(), F.col("doc_id").desc())
    ranked = texts.select(*RECORD, "text", F.row_number().over(newest).alias("r"), F.to_json(F.array(*RECORD)).alias("record")).where("r <= 2")
    before, after = (ranked.where(f"r = {r}").select("record", "text") for r in (2, 1))
    cut = lambda rows: sections.sections(rows, "record", "text")
    return sections.changes(cut(before), cut(after.join(before.select("record"), "record", "left_semi")), "record")


@_query("SELECT c.id, md5(value) AS digest, CASE WHEN length(value) > 160 THEN substr(value, 1, 160) || '…' ELSE value END AS shown FROM c WHERE value IS NOT NULL")
def value_digest(spark, d):
    rows = _c(spark, d, "value").where("value IS NOT NULL")
    return rows.select("id", F.md5("value").alias("digest"), shortened(F.col("value")).alias("shown"))


@_query(
    """, k AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM c), b AS (SELECT key, h, list_transform(range(0, length(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS bytes FROM k)
    SELECT key, list_reduce(list_prepend(2166136261::BIGINT, bytes), lambda h, x: (xor(h, x) * 16777619) % 4294967296)::BIGINT AS hash FROM b"""
)
def seeded_hash(spark, d):
    """The layout hash of every key, over its bytes."""
    return _c(spark, d, "key").select("key").distinct().select("key", fnv1a(F.col("key")).alias("hash"))


@_query("SELECT facet, proposed_key, count(DISTINCT tendable_id) AS records, count(*) AS occurrences, min(id) AS first_id FROM s WHERE status = 'pending' GROUP BY 1, 2")
def gaps(spark, d):
    return vocabulary.gaps(_suggestions(spark, d))


@_query(
    """, cut AS (SELECT proposed_key, max(updated_at) AS cut FROM s WHERE status <> 'pending' GROUP BY 1), f AS (SELECT proposed_key, facet, count(*) AS n FROM s WHERE status = 'pending' GROUP BY 1, 2),
    t AS (SELECT proposed_key, facet AS top_facet FROM (SELECT *, row_number() OVER (PARTITION BY proposed_key ORDER BY n DESC, facet) AS r FROM f) WHERE r = 1)
    SELECT proposed_key, count(*) AS pressure, count(DISTINCT tendable_id) AS records, count(*) FILTER (created_at > cut) AS resurged, any_value(top_facet) AS top_facet FROM s LEFT JOIN cut USING (proposed_key) JOIN t USING (proposed_key) WHERE status = 'pending' GROUP BY 1"""
)
def term_pressure(spark, d):
    return vocabulary.pressure(_suggestions(spark, d))


@_query(
    """, x AS (SELECT mapped_to AS preferred, proposed_key AS variant, facet FROM s WHERE status = 'mapped' AND mapped_to IS NOT NULL UNION ALL SELECT proposed_key, NULL, facet FROM s WHERE status = 'approved')
    SELECT preferred, coalesce(string_agg(DISTINCT variant, ',' ORDER BY variant), '') AS variants, count(DISTINCT variant) AS n_variants, count(DISTINCT facet) AS facets, count(DISTINCT facet) >= 3 AS dumping_ground FROM x GROUP BY 1"""
)
def authority_rings(spark, d):
    return vocabulary.rings(_suggestions(spark, d))


@_query("SELECT facet, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'mapped') AS mapped, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected FROM s GROUP BY 1")
def facet_rollup(spark, d):
    return vocabulary.status_pivot(_suggestions(spark, d))


@_query("SELECT facet, string_agg(DISTINCT proposed_key, ',' ORDER BY proposed_key) AS additions FROM s WHERE status = 'approved' AND proposed_key IS NOT NULL GROUP BY 1")
def contract_additions(spark, d):
    return vocabulary.additions(_suggestions(spark, d))


@_query("SELECT DISTINCT facet, proposed_key, mapped_to FROM s WHERE status = 'mapped'")
def synonyms(spark, d):
    return vocabulary.synonyms(_suggestions(spark, d))


@_query("SELECT DISTINCT proposed_key FROM s WHERE status <> 'pending'")
def resolved_keys(spark, d):
    return vocabulary.resolved(_suggestions(spark, d))


@_query(
    """, pk AS (SELECT proposed_key, count(DISTINCT tendable_type || ':' || tendable_id) AS n FROM s GROUP BY 1), ap AS (SELECT count(DISTINCT proposed_key) AS n FROM s WHERE status = 'approved'),
    va AS (SELECT count(*) AS n FROM (SELECT DISTINCT mapped_to, proposed_key FROM s WHERE status = 'mapped' AND mapped_to IS NOT NULL AND proposed_key IS NOT NULL))
    SELECT count(*) AS distinct_keys, (SELECT n FROM ap) AS preferred_terms, (SELECT n FROM va) AS variant_keys, round((SELECT n FROM va) / nullif((SELECT n FROM ap), 0), 2) AS proliferation,
    count(*) FILTER (n = 1) AS one_off_keys, round(100.0 * count(*) FILTER (n = 1) / nullif(count(*), 0))::BIGINT AS one_off_pct FROM pk"""
)
def vocab_metrics(spark, d):
    return vocabulary.metrics(_suggestions(spark, d))


@_query("SELECT count(DISTINCT claim_id) FILTER (source = 'examiner') AS audited, count(DISTINCT claim_id) FILTER (source = 'human') AS reviewed FROM a")
def review_counts(spark, d):
    return audits.reviewed(_a(spark, d))


@_query("SELECT proposed_key, status, mapped_to FROM (SELECT *, row_number() OVER (PARTITION BY proposed_key ORDER BY updated_at DESC, id DESC) AS r FROM s WHERE status <> 'pending') WHERE r = 1")
def newest_verdicts(spark, d):
    return vocabulary.newest_verdicts(_suggestions(spark, d))


@_query("SELECT time_bucket(INTERVAL 1 DAY, created_at) AS start, facet, status, count(*) AS visits, coalesce(sum(tokens_total), 0)::BIGINT AS tokens FROM v WHERE created_at IS NOT NULL GROUP BY 1, 2, 3")
def window_visits(spark, d):
    return stream.per_window(_v(spark, d, "created_at", "facet", "status", "tokens_total"))


@_query(
    """, o AS (SELECT tendable_type, tendable_id, created_at, created_at >= lag(created_at) OVER w + INTERVAL 6 HOUR AS gap FROM v WHERE created_at IS NOT NULL WINDOW w AS (PARTITION BY tendable_type, tendable_id ORDER BY created_at)),
    g AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY tendable_type, tendable_id ORDER BY created_at) AS n FROM o)
    SELECT tendable_type, tendable_id, min(created_at) AS start, max(created_at) + INTERVAL 6 HOUR AS "end", count(*) AS visits FROM g GROUP BY tendable_type, tendable_id, n"""
)
def visit_sessions(spark, d):
    return stream.sessions(_v(spark, d, *RECORD, "created_at"))


@_query(
    """, q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS place FROM p) SELECT query, vec_id, distance FROM r WHERE place <= 10"""
)
def knn(spark, d):
    rows = table(spark, d, "embeddings")
    near = vectors.knn(rows, "vec_id", "embedding", rows.where("vec_id % 100 = 0"), 10)
    return near.select("query", "vec_id", F.round("distance", 6).alias("distance"))


@_query(
    """, q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE e.label IN (1, 2, 3)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS place FROM p) SELECT query, vec_id, distance, place::INT AS place FROM r WHERE place > 8 AND place <= 16"""
)
def search_page(spark, d):
    """The second page of eight of what is nearest to each query among the rows of some labels, with distances."""
    rows = table(spark, d, "embeddings")
    near = vectors.page(rows.where(F.col("label").isin(1, 2, 3)), "vec_id", "embedding", rows.where("vec_id % 100 = 0"), 2, 8)
    return near.select("query", "vec_id", F.round("distance", 6).alias("distance"), "place")


@_query(
    """, t AS (SELECT tendable_type, tendable_id, max_by(x, (liked, CASE WHEN liked = 0 THEN length(x) ELSE 0 END, -id)) AS told FROM (SELECT *, value::JSON->>'$' AS x, regexp_matches(lower(key), 'summary|abstract|description|overview')::INT AS liked FROM lively WHERE json_type(value::JSON) = 'VARCHAR')
      WHERE trim(x) <> '' GROUP BY 1, 2), d AS (SELECT tendable_type, tendable_id, min_by(text, doc_id) AS source FROM documents WHERE text IS NOT NULL AND tendable_type IS NOT NULL AND tendable_id IS NOT NULL GROUP BY 1, 2)
    SELECT tendable_type, tendable_id, substr(trim(regexp_replace(coalesce(told, source), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 220) AS excerpt FROM t FULL JOIN d USING (tendable_type, tendable_id)"""
)
def excerpts(spark, d):
    held = _c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status")
    parsed = F.try_parse_json("value")
    text = F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string"))
    source = table(spark, d, "documents").where("tendable_type IS NOT NULL AND tendable_id IS NOT NULL")
    return claims.excerpts(held.withColumn("text", text), source)


def delivered_repeats(spark, d):
    """Ids that came more than once and the versions that came."""
    return table(spark, d, "enliterator_visits").groupBy("id").agg(F.count("*").alias("rows"), F.count_distinct("updated_at").alias("versions")).where("rows > 1")


QUERIES["delivered_repeats"] = delivered_repeats
SQL["delivered_repeats"] = "SELECT id, count(*) AS rows, count(DISTINCT updated_at) AS versions FROM enliterator_visits GROUP BY 1 HAVING count(*) > 1"


def term_frequency(spark, d):
    """Values' terms over the live claims, by key."""
    rows = _c(spark, d, *RECORD, "key", "value", "superseded_by_id", "status").where(claims.live())
    return rows.select(*RECORD, "key", F.explode(terms(F.col("value"))).alias("term")).groupBy("key", "term").agg(F.count_distinct(*RECORD).alias("records"))


QUERIES["term_frequency"] = term_frequency
SQL["term_frequency"] = (
    _WITH
    + """, i2 AS (SELECT tendable_type, tendable_id, key, value::JSON AS x FROM lively WHERE json_type(value::JSON) <> 'ARRAY' UNION ALL SELECT tendable_type, tendable_id, key, unnest(json_extract(value::JSON, '$[*]')) FROM lively WHERE json_type(value::JSON) = 'ARRAY'),
    t AS (SELECT tendable_type, tendable_id, key, CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' WHEN 'OBJECT' THEN CASE WHEN json_type(coalesce(x->'$.designation', x->'$.name')) = 'VARCHAR' THEN coalesce(x->>'$.designation', x->>'$.name') END END AS term FROM i2)
    SELECT key, term, count(DISTINCT (tendable_type, tendable_id)) AS records FROM t WHERE term IS NOT NULL GROUP BY 1, 2"""
)
