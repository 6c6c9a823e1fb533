"""Verdicts on claims and what they say about accuracy. Audits come deduplicated by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts of agents carry no weight.
INSTRUMENTS = ("examiner", "human")


def instrument(audits: DataFrame) -> DataFrame:
    return audits.where(F.col("source").isin(*INSTRUMENTS))


def _newest() -> Column:
    return F.struct((F.col("source") == "human").alias("human"), "created_at", "id")


def effective(audits: DataFrame) -> DataFrame:
    """claim_id, source, verdict: the latest human verdict of a claim, else the latest examiner's; the greater id among equal clocks."""
    best = F.max_by(F.struct("source", "verdict"), _newest()).alias("v")
    return instrument(audits).groupBy("claim_id").agg(best).select("claim_id", "v.source", "v.verdict")


def accuracy(audits: DataFrame, claims: DataFrame, visits: DataFrame) -> DataFrame:
    """facet, tier, audited, live, counts by verdict, supported_rate: unverifiable ones are outside the rate, superseded claims inside."""
    judged = effective(audits).alias("e").join(claims.select("id", "visit_id", "tier", "status", "superseded_by_id").alias("c"), F.expr("e.claim_id = c.id"))
    placed = judged.join(visits.select("id", "facet").alias("v"), F.expr("c.visit_id = v.id"), "left")
    tier = F.when(F.trim(F.coalesce("c.tier", F.lit(""))) == "", "unknown").otherwise(F.col("c.tier"))
    cells = placed.groupBy(F.coalesce("v.facet", F.lit("host")).alias("facet"), tier.alias("tier")).agg(
        F.count("*").alias("audited"),
        F.count_if(F.expr("c.superseded_by_id IS NULL AND coalesce(c.status, '') <> 'superseded'")).alias("live"),
        *(F.count_if(F.col("e.verdict") == v).alias(v) for v in ("supported", "unsupported", "contradicted", "unverifiable")),
    )
    decided = F.expr("supported + unsupported + contradicted")
    return cells.withColumn("supported_rate", F.when(decided > 0, F.round(F.col("supported") / decided, 3)))


def pairs(audits: DataFrame) -> DataFrame:
    """claim_id, examiner, human: the latest verdict of each, of claims that have both."""
    newest = lambda who: F.max_by(F.when(F.col("source") == who, F.col("verdict")), F.when(F.col("source") == who, F.struct("created_at", "id"))).alias(who)
    return instrument(audits).groupBy("claim_id").agg(newest("examiner"), newest("human")).where("examiner IS NOT NULL AND human IS NOT NULL")


def agreement(audits: DataFrame, least: int = 10) -> DataFrame:
    """One row: overlaps, agreements, rate (null under `least` overlaps), examiner_supported, overruled_supported; unverifiable pairs are left out."""
    usable = pairs(audits).where("examiner <> 'unverifiable' AND human <> 'unverifiable'")
    counts = usable.agg(
        F.count("*").alias("overlaps"),
        F.count_if(F.expr("(examiner = 'supported') = (human = 'supported')")).alias("agreements"),
        F.count_if(F.expr("examiner = 'supported'")).alias("examiner_supported"),
        F.count_if(F.expr("examiner = 'supported' AND human <> 'supported'")).alias("overruled_supported"),
    )
    return counts.withColumn("rate", F.when(F.col("overlaps") >= least, F.round(F.col("agreements") / F.col("overlaps"), 3)))


def confusion(audits: DataFrame) -> DataFrame:
    """examiner, human, n of the usable pairs."""
    return pairs(audits).where("examiner <> 'unverifiable' AND human <> 'unverifiable'").groupBy("examiner", "human").agg(F.count("*").alias("n"))


def sample(claims: DataFrame, audits: DataFrame, visits: DataFrame, n: int) -> DataFrame:
    """claim_id, facet, tier, place: `n` live claims never examined, dealt round-robin over the cells of facet and tier.

    Within a cell the order is that of a hash of the id. A round-robin deal is the
    order by place in the cell, so a cell needs no more than its first `n`.
    """
    open_ = claims.where("superseded_by_id IS NULL AND coalesce(status, '') <> 'superseded' AND NOT coalesce(locked, false) AND visit_id IS NOT NULL")
    fresh = open_.alias("c").join(instrument(audits).select("claim_id").alias("a"), F.expr("c.id = a.claim_id"), "left_anti")
    celled = fresh.join(visits.select("id", "facet").alias("v"), F.expr("c.visit_id = v.id"))
    cells = celled.select(F.col("c.id").alias("claim_id"), "v.facet", F.coalesce("c.tier", F.lit("unknown")).alias("tier"), F.md5(F.col("c.id").cast("string")).alias("draw"))
    ranked = cells.withColumn("place", F.row_number().over(Window.partitionBy("facet", "tier").orderBy("draw", "claim_id"))).where(F.col("place") <= n)
    return ranked.orderBy("place", "draw", "claim_id").limit(n).drop("draw")


def review_queue(audits: DataFrame, n: int) -> DataFrame:
    """claim_id, verdict, place: claims without a human verdict, two thirds doubted ones (unverifiable last), one third supported."""
    human = audits.where("source = 'human'").select("claim_id")
    newest = F.struct("created_at", "id")
    last = audits.where("source <> 'human'").groupBy("claim_id").agg(F.max_by("verdict", newest).alias("verdict"), F.max(newest).alias("at"))
    waiting = last.join(human, "claim_id", "left_anti")
    doubted, supported = -(-2 * n // 3), n - -(-2 * n // 3)
    rank = F.when(F.col("verdict") == "unverifiable", 1).otherwise(0)
    some = lambda rows, k: rows.orderBy(rank, F.col("at").desc(), "claim_id").limit(k).select("claim_id", "verdict")
    return some(waiting.where("verdict <> 'supported'"), doubted).unionByName(some(waiting.where("verdict = 'supported'"), supported))


def reviewed(audits: DataFrame) -> DataFrame:
    """audited, reviewed: the claims that an examiner, and that a person, gave a verdict on."""
    distinct = lambda source: F.count_distinct(F.when(F.col("source") == source, F.col("claim_id")))
    return audits.agg(distinct("examiner").alias("audited"), distinct("human").alias("reviewed"))
