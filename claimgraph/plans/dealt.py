"""Queries of the general problems over the claim store, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators import hierarchy, weighted
from claimgraph.sources import records, table

LANE = ["context_id", "facet", "tendable_type"]


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id, parent of every claim and visit; source 0 is claims, 1 visits."""
    claims = records(table(spark, sf_dir, "enliterator_claims"), "superseded_by_id")
    visits = records(table(spark, sf_dir, "enliterator_visits"), "escalated_from_id")
    one = claims.select(F.lit(0).cast("byte").alias("source"), "id", F.col("superseded_by_id").alias("parent"))
    return one.unionByName(visits.select(F.lit(1).cast("byte").alias("source"), "id", F.col("escalated_from_id").alias("parent")))


def _known(nodes: DataFrame) -> DataFrame:
    """Linked records, with whether the link's target exists."""
    linked = nodes.where("parent IS NOT NULL").alias("l")
    there = nodes.select("source", F.col("id").alias("there")).alias("t")
    joined = linked.join(there, (F.col("l.source") == F.col("t.source")) & (F.col("l.parent") == F.col("t.there")), "left")
    return joined.select("l.*", F.col("t.there").isNotNull().alias("found"))


def _source(column: str = "source") -> Column:
    return F.when(F.col(column) == 0, F.lit("claim")).otherwise(F.lit("visit")).alias("source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every claim and visit that has a link; depth -1 where links never end."""
    known = _known(_links(spark, sf_dir))
    nodes = hierarchy.forest(known.where("found").select("source", "id", "parent"), ["source"])
    ends = nodes.select("source", F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("depth")).cast("long").alias("depth"))
    loose = known.where("NOT found").select("source", F.col("id").alias("node_id"), F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"))
    return ends.unionByName(loose).select(_source(), "node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path of every linked claim and visit to the end of its chain, as text, and its number of descendants."""
    known = _known(_links(spark, sf_dir))
    nodes = hierarchy.forest(known.where("found").select("source", "id", "parent"), ["source"])
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")
    below = ((F.col("leave") - F.col("enter") - 1) / 2).cast("long").alias("n_below")
    sized = nodes.select("source", F.col("id").alias("node"), below)
    joined = hierarchy.paths(nodes, ["source"]).alias("p").join(sized.alias("s"), (F.col("p.source") == F.col("s.source")) & (F.col("p.id") == F.col("s.node")))
    return joined.select(_source("p.source"), F.col("id").alias("node_id"), F.col("root").alias("root_id"), "cyclic", path, "n_below")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair of claims and of visits, with the links between them."""
    known = _known(_links(spark, sf_dir))
    nodes = hierarchy.forest(known.where("found").select("source", "id", "parent"), ["source"])
    return hierarchy.descendants(nodes, ["source"]).select(_source(), "ancestor", "descendant", "links")


def _lanes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    visits = records(table(spark, sf_dir, "enliterator_visits"), *LANE, *columns)
    return visits.withColumn("context_id", F.coalesce("context_id", F.lit(0).cast("long")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes that hold at least a hundredth of all visits."""
    lanes = weighted.profile(weighted.frequencies(_lanes(spark, sf_dir, "status"), LANE, "status"), LANE)
    return weighted.heavy(lanes, 100).select(*LANE)


def p3_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lane's visits, tendable records, commonest record and exact percentiles of tokens."""
    visits = _lanes(spark, sf_dir, "tendable_id", "tokens_total")
    counted = weighted.profile(weighted.frequencies(visits, LANE, "tendable_id"), LANE)
    tokens = weighted.percentiles(weighted.frequencies(visits, LANE, "tokens_total"), LANE, (0.5, 0.9))
    same = F.lit(True)
    for k in LANE:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}"))
    joined = counted.alias("c").join(tokens.alias("t"), same, "left")
    return joined.select(*(f"c.{k}" for k in LANE), "c.n", F.col("c.n_distinct").alias("n_records"), F.col("c.mode").alias("busiest"), F.col("t.p50").alias("tokens_p50"), F.col("t.p90").alias("tokens_p90"))


_RECORDS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS version_no FROM {0}) WHERE version_no = 1 AND id IS NOT NULL)"
_CHAIN = f"""
WITH RECURSIVE n AS MATERIALIZED (
  SELECT 'claim' AS source, id, superseded_by_id AS parent FROM {_RECORDS.format("enliterator_claims")}
  UNION ALL SELECT 'visit', id, escalated_from_id FROM {_RECORDS.format("enliterator_visits")}),
e AS MATERIALIZED (SELECT a.source, a.id, b.id AS parent FROM n a LEFT JOIN n b ON a.source = b.source AND a.parent = b.id WHERE a.parent IS NOT NULL),
walk AS (
  SELECT source, id, id AS pos, cast(0 AS bigint) AS links, [id] AS path, false AS looped FROM e
  UNION ALL
  SELECT w.source, w.id, e.parent, w.links + 1, list_append(w.path, e.parent), list_contains(w.path, e.parent)
  FROM walk w JOIN e ON e.source = w.source AND e.id = w.pos WHERE e.parent IS NOT NULL AND NOT w.looped),
final AS (SELECT source, id, max_by(pos, links) AS pos, max(links) AS links, max_by(path, links) AS path, bool_or(looped) AS looped FROM walk GROUP BY source, id),
ends AS (SELECT source, id, looped, CASE WHEN looped THEN list_min(list_slice(path, list_position(path, pos), len(path))) ELSE pos END AS root, links, path FROM final)
"""

SQL = {
    "p2_found": _CHAIN + "SELECT source, id AS node_id, root AS root_id, CASE WHEN looped THEN cast(-1 AS bigint) ELSE links END AS depth FROM ends",
    "p2_descendants": _CHAIN
    + """SELECT w.source, w.pos AS ancestor, w.id AS descendant, w.links FROM walk w JOIN ends d ON d.source = w.source AND d.id = w.id
    WHERE w.links > 0 AND w.links <= coalesce(CASE WHEN d.looped THEN list_position(d.path, d.root) - 1 ELSE d.links END, 0)""",
    "p2_paths": _CHAIN
    + """, up AS (SELECT d.source, d.id, d.looped, d.root, CASE WHEN d.looped THEN list_slice(d.path, 1, list_position(d.path, d.root)) ELSE d.path END AS path FROM ends d JOIN e ON e.source = d.source AND e.id = d.id WHERE e.parent IS NOT NULL),
    below AS (SELECT source, pos, count(*) - 1 AS n FROM (SELECT source, unnest(path) AS pos FROM up) GROUP BY 1, 2)
    SELECT up.source, up.id AS node_id, up.root AS root_id, up.looped AS cyclic, array_to_string(up.path, '>') AS path, below.n AS n_below FROM up JOIN below ON below.source = up.source AND below.pos = up.id""",
    "p3_found": f"""
    SELECT coalesce(context_id, 0) AS context_id, facet, tendable_type FROM {_RECORDS.format("enliterator_visits")}
    GROUP BY 1, 2, 3 HAVING count(*) * 100 >= (SELECT count(DISTINCT id) FROM enliterator_visits)""",
    "p3_lanes": f"""
    WITH v AS (SELECT *, coalesce(context_id, 0) AS lane FROM {_RECORDS.format("enliterator_visits")}),
    m AS (SELECT lane, facet, tendable_type, tendable_id, row_number() OVER (PARTITION BY lane, facet, tendable_type ORDER BY count(*) DESC, tendable_id) AS r
      FROM v WHERE tendable_id IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT v.lane AS context_id, v.facet, v.tendable_type, count(*) AS n, count(DISTINCT v.tendable_id) AS n_records, any_value(m.tendable_id) AS busiest,
      quantile_disc(v.tokens_total, 0.5) AS tokens_p50, quantile_disc(v.tokens_total, 0.9) AS tokens_p90
    FROM v LEFT JOIN m ON m.r = 1 AND m.lane = v.lane AND m.facet IS NOT DISTINCT FROM v.facet AND m.tendable_type IS NOT DISTINCT FROM v.tendable_type
    GROUP BY 1, 2, 3""",
}

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_lanes": p3_lanes}
