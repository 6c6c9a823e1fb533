"""What happened in a window of time, what plans hold, and how far campaigns have come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["tendable_type", "tendable_id"]


def _one(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def activity(visits: DataFrame) -> DataFrame:
    """dimension, label, status, n, tokens: visits by facet and status, by tier and by reason ('—' for none), in one pass."""
    dash = lambda c: F.coalesce(c, F.lit("—"))
    status, none = F.col("status"), F.lit(None).cast("string")
    sides = F.array(*(F.struct(F.lit(n).alias("dimension"), c.alias("label"), s.alias("status")) for n, c, s in (("facet", F.col("facet"), status), ("tier", dash("tier"), none), ("reason", dash("reason"), none))))
    spread = visits.select(F.inline(sides), "tokens_total")
    return spread.groupBy("dimension", "label", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens"))


def headline(visits: DataFrame) -> DataFrame:
    """One row: cycles, visits, failed, deep_reads, records, tokens."""
    return visits.agg(
        F.count_distinct("heartbeat_id").alias("cycles"),
        F.count("*").alias("visits"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("reason") == "deep_read").alias("deep_reads"),
        F.count_distinct(F.struct(*RECORD)).alias("records"),
        F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def failures(visits: DataFrame, most: int = 10) -> DataFrame:
    """id, record, facet, tier, truncated: the newest failures, at most `most`, and whether there are more."""
    failed = visits.where("status = 'failed'")
    shown = failed.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)
    total = failed.agg((F.count("*") > most).alias("truncated"))
    return shown.crossJoin(F.broadcast(total)).select("id", *RECORD, "facet", "tier", "truncated")  # one row


def sessions(visits: DataFrame, parents: DataFrame, part: str, reason: str) -> DataFrame:
    """One row of the visits for `reason`: records (of parts, their parents), parts_read, parts_failed, syntheses, tokens.

    `parents` has part_id, record_type and record_id; visits of the type `part` are
    its rows. A part without a parent is no record.
    """
    deep = visits.where(F.col("reason") == reason)
    linked = deep.where(F.col("tendable_type") == part).alias("v").join(parents.alias("p"), F.expr("v.tendable_id = p.part_id"))
    whole = deep.where(F.col("tendable_type") != part)
    records = linked.select(F.col("record_type").alias("t"), F.col("record_id").alias("i")).unionByName(whole.select(F.col("tendable_type").alias("t"), F.col("tendable_id").alias("i"))).distinct()
    is_part = F.col("tendable_type") == part
    ended = lambda s: F.count_distinct(F.when(is_part & (F.col("status") == s), F.col("tendable_id")))
    counts = deep.agg(
        ended("succeeded").alias("parts_read"),
        ended("failed").alias("parts_failed"),
        F.count_distinct(F.when(~is_part & (F.col("status") == "succeeded"), F.struct(*RECORD, "facet"))).alias("syntheses"),
        F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens"),
    )
    return records.agg(F.count("*").alias("records")).crossJoin(counts)  # one row each


def motion(suggestions: DataFrame, audits: DataFrame) -> DataFrame:
    """kind, label, n: suggestions by status, audits by source and verdict."""
    told = suggestions.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("n")).select(F.lit("suggestion").alias("kind"), "label", "n")
    heard = audits.groupBy(F.concat_ws("/", "source", "verdict").alias("label")).agg(F.count("*").alias("n")).select(F.lit("audit").alias("kind"), "label", "n")
    return told.unionByName(heard)


def executed(visits: DataFrame) -> DataFrame:
    """heartbeat_id, executed: for each cycle a map from reason to a map from status to number."""
    counts = visits.where("heartbeat_id IS NOT NULL").groupBy("heartbeat_id", F.coalesce("reason", F.lit("—")).alias("reason"), "status").agg(F.count("*").alias("n"))
    inner = counts.groupBy("heartbeat_id", "reason").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("by_status"))
    return inner.groupBy("heartbeat_id").agg(F.map_from_entries(F.collect_list(F.struct("reason", "by_status"))).alias("executed"))


def compacted(ledger: DataFrame, key: str = "heartbeat_id", nested: str = "executed") -> DataFrame:
    """key, status, n: nested maps summed over their reasons; numbers that are not positive are left out."""
    return ledger.select(key, F.explode(nested).alias("reason", "m")).select(key, F.explode("m").alias("status", "n")).where("n > 0").groupBy(key, "status").agg(F.sum("n").cast("bigint").alias("n"))


def deficits(visits: DataFrame) -> DataFrame:
    """heartbeat_id, enqueued, landed, previous_deficit: what each cycle queued, what of it ended, and what the cycle before left open."""
    cycles = visits.where("heartbeat_id IS NOT NULL").groupBy("heartbeat_id").agg(F.count("*").alias("enqueued"), F.count_if(F.col("status").isin("succeeded", "failed")).alias("landed"))
    # The cycle before is found by a join on the next smaller id, not by a window over all cycles.
    ids = cycles.select(F.col("heartbeat_id").alias("h"), (F.col("enqueued") - F.col("landed")).alias("previous_deficit"))
    return cycles.join(ids, F.col("heartbeat_id") - 1 == F.col("h"), "left").drop("h")


def plan_counts(items: DataFrame, lane: str, cost: str) -> DataFrame:
    """reason, lane, n, tokens: planned items by reason, by lane and reason, and in all (nulls stand for all)."""
    return items.groupingSets([["reason"], [lane, "reason"], []], "reason", lane).agg(F.count("*").alias("n"), F.sum(cost).cast("bigint").alias("tokens"))


def horizon(waiting: DataFrame, costs: DataFrame, budget: int) -> DataFrame:
    """One row: remaining, tokens, cycles: what the items of all lanes will cost, and how many budgets that is, rounded up."""
    priced = waiting.join(costs, "facet")
    total = priced.agg(F.coalesce(F.sum("waiting"), F.lit(0)).cast("bigint").alias("remaining"), F.coalesce(F.sum(F.col("waiting") * F.col("est")), F.lit(0)).cast("bigint").alias("tokens"))
    return total.withColumn("cycles", F.ceil(F.col("tokens") / budget).cast("bigint"))


def progress(visits: DataFrame, at: object) -> DataFrame:
    """One row: tended, rederived, remaining, share: the record-facets read before an instant, and those of them read again since."""
    t = F.lit(at).cast("timestamp_ntz")
    read = visits.where("status = 'succeeded' AND applied").groupBy(*RECORD, "facet").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")).where(F.col("first_at") < t)
    done = F.count_if(F.col("last_at") >= t)
    share = F.when(F.count("*") == 0, 0.0).otherwise(F.round(done / F.count("*"), 3))
    return read.agg(F.count("*").alias("tended"), done.alias("rederived"), (F.count("*") - done).alias("remaining"), share.alias("share"))


def pulse(visits: DataFrame) -> DataFrame:
    """reason, items, tokens, last_at of the latest cycle: different items done, by reason."""
    latest = visits.agg(F.max("heartbeat_id").alias("heartbeat_id"))
    rows = visits.join(F.broadcast(latest), "heartbeat_id").where("status = 'succeeded'")  # one row
    return rows.groupBy(F.coalesce("reason", F.lit("—")).alias("reason")).agg(F.count_distinct(F.struct(*RECORD, "facet")).alias("items"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens"), F.max("finished_at").alias("last_at"))


def strip(**tables: DataFrame) -> DataFrame:
    """measure, n: how many rows each table has."""
    return stacked([_one(name, rows) for name, rows in tables.items()])


def wave(visits: DataFrame, approvals: DataFrame, most: int) -> DataFrame:
    """facet, record, last_started, place, remaining: what was last read before the newest approval of its facet, longest ago first, `most` a facet; `remaining` of the facet are more than shown.

    `approvals` has facet and approved_at. Visits without a start are left out.
    """
    newest = approvals.groupBy("facet").agg(F.max("approved_at").alias("approved_at"))
    read = visits.where("status = 'succeeded' AND applied AND started_at IS NOT NULL").groupBy("facet", *RECORD).agg(F.max("started_at").alias("last_started"))
    behind = read.join(F.broadcast(newest), "facet").where("last_started < approved_at").drop("approved_at")  # a row for each facet
    counts = behind.groupBy("facet").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remaining"))
    ranked = behind.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy("last_started", *RECORD))).where(F.col("place") <= most)
    return ranked.join(counts, "facet")


def active_lanes(visits: DataFrame, since: DataFrame) -> DataFrame:
    """facet, context_id, active: whether a lane has had a visit since the one instant in `since` (one row and column)."""
    (name,) = since.columns
    last = visits.groupBy("facet", "context_id").agg(F.max("created_at").alias("last_at"))
    return last.crossJoin(F.broadcast(since)).select("facet", "context_id", F.coalesce(F.col("last_at") > F.col(name), F.lit(False)).alias("active"))  # one row
