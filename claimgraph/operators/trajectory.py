"""How a record's claims changed from reading to reading of a facet."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import plain_value
from claimgraph.operators.claims import CHURN, similarities
from claimgraph.operators.visits import applied, numbered

RECORD = ["tendable_type", "tendable_id"]
LANE = [*RECORD, "facet"]
#: A visit leaves what was there a millisecond before the next.
BEFORE = 1_000
_CHANGES = "tendable_type string, tendable_id string, facet string, key string, visit_id long, kind string, from_id long, to_id long"


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of each lane's key, from its claims' starts and ends in order of steps.

    One pass over sorted rows; what is held are the claims of one key that are live.
    The latest live claim stands for the key.
    """
    names = [c.split()[0] for c in _CHANGES.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    group, at, visit, heap, ended, before = None, None, None, [], set(), None

    def close():
        nonlocal before
        while heap and -heap[0][1] in ended:
            ended.discard(-heapq.heappop(heap)[1])
        now = -heap[0][1] if heap else None
        if now != before and at is not None:
            yield (*group, visit, "added" if before is None else "deleted" if now is None else "changed", before, now)
        before = now

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    for batch in batches:
        out = []
        for *key, step, reading, edge, born, claim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is not None and (key != group or step != at):
                out += close()
            if key != group:
                group, heap, ended, before = key, [], set(), None
            at, visit = step, reading
            if edge > 0:
                heapq.heappush(heap, (-born, -claim))
            else:
                ended.add(claim)
        if out:
            yield rows(out)
    if group is not None and (last := list(close())):
        yield rows(last)


def timeline(visits: DataFrame, claims: DataFrame) -> DataFrame:
    """record, facet, visit_id, key, kind, from_id, to_id, from_value, to_value: what each applied visit of a facet left behind that differs from what the one before it left.

    A visit leaves the claims that live just before the next later visit of its
    record and facet, the last one those at the end of the log; only claims made by
    visits of that facet count, and of those under one key the latest. A claim lives
    from its creation to its successor's (a successor without a row never came), or,
    withdrawn without one, to its last update. Visits at the same instant leave the
    same, and the change is that of the first by id. The first visit has nothing
    before it. Visits and claims without a creation date are left out. Starts and
    ends are placed among the visits by running extremes and swept in their order,
    so no claim is paired with every visit.
    """
    none = lambda kind: F.lit(None).cast(kind)
    read = applied(visits).where("created_at IS NOT NULL").select(*LANE, none("string").alias("key"), _micros("created_at").alias("t"), F.lit(0).alias("edge"), none("long").alias("born"), F.col("id").alias("of"))

    facets = visits.select(F.col("id").alias("__visit"), *(F.col(k).alias(f"__{k}") for k in LANE))
    same = (F.col("visit_id") == F.col("__visit")) & F.col("tendable_type").eqNullSafe(F.col("__tendable_type")) & F.col("tendable_id").eqNullSafe(F.col("__tendable_id"))
    made = claims.where("created_at IS NOT NULL").join(facets, same)
    successors = claims.select(F.col("id").alias("__next"), _micros("created_at").alias("__ended"))
    held = made.join(successors, F.col("superseded_by_id") == F.col("__next"), "left")
    open_ = F.when(F.col("superseded_by_id").isNotNull(), F.col("__next").isNull()).otherwise(F.coalesce("status", F.lit("")) != "superseded")
    ended = F.when(~open_, F.coalesce("__ended", F.when(F.col("superseded_by_id").isNull(), _micros("updated_at"))))
    lives = held.select(*RECORD, F.col("__facet").alias("facet"), "key", _micros("created_at").alias("born"), ended.alias("ended"), open_.alias("open"), F.col("id").alias("of")).where("open OR ended > born")
    edges = F.inline(F.array(F.struct(F.col("born").alias("t"), F.lit(1).alias("edge")), F.struct(F.col("ended").alias("t"), F.lit(-1).alias("edge"))))
    marks = lives.select("*", edges).where("t IS NOT NULL").select(*LANE, "key", (F.col("t") + BEFORE).alias("t"), "edge", "born", "of")

    # The visit that left what happened at an instant is the last one before it; at equal times the visit comes after.
    order = Window.partitionBy(*LANE).orderBy("t", F.col("edge") == 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    visit = F.col("edge") == 0
    seen = {"last": F.max(F.when(visit, F.struct("t", (-F.col("of")).alias("of")))).over(order), "first": F.min(F.when(visit, F.struct("t", "of"))).over(order)}
    placed = read.unionByName(marks).withColumns(seen).where("edge <> 0")
    # No step: left by the first visit, or there before it.
    step = F.when(F.col("last.t") > F.col("first.t"), F.col("last.t")).alias("step")
    sweep = placed.select(*LANE, "key", step, (-F.col("last.of")).alias("visit"), "edge", "born", "of").repartition(*LANE, "key").sortWithinPartitions(*LANE, "key", "step")
    changes = sweep.mapInArrow(_swept, _CHANGES)
    value = lambda p: claims.select(F.col("id").alias(f"{p}_id"), F.col("value").alias(f"{p}_value"))
    return changes.join(value("from"), "from_id", "left").join(value("to"), "to_id", "left").select(*LANE, "visit_id", "key", "kind", "from_id", "to_id", "from_value", "to_value")


def compounding(visits: DataFrame, claims: DataFrame, last: int = 50) -> DataFrame:
    """pass, updated, churned, churn_rate over the n-th readings of records on facets, numbered as `visits.passes` does.

    `churned` are the changes that a reading left which only restate the value
    before (a null value is written 'null', a string without its quotes); the rate is of the updates that visits
    report, null without any. The first of the `last` readings has nothing before it.
    """
    changed = timeline(visits, claims).where("kind = 'changed'")
    text = lambda c: F.coalesce(plain_value(F.col(c)), F.lit("null")).alias(c)
    pairs = changed.select(F.to_json(F.struct("visit_id", "key"), {"ignoreNullFields": "false"}).alias("__pair"), "visit_id", text("from_value"), text("to_value"))
    alike = similarities(pairs, "__pair", "from_value", "to_value").where(F.col("similarity") > CHURN)
    churned = pairs.select("__pair", "visit_id").join(alike, "__pair").groupBy("visit_id").agg(F.count("*").alias("churned"))
    read = numbered(visits, last).select("id", "pass", F.coalesce("n_updated", F.lit(0)).alias("updated"))
    joined = read.join(churned, F.col("id") == F.col("visit_id"), "left")
    totals = joined.groupBy("pass").agg(F.sum("updated").cast("bigint").alias("updated"), F.sum(F.when(F.col("pass") > 1, F.coalesce("churned", F.lit(0))).otherwise(0)).cast("bigint").alias("churned"))
    return totals.withColumn("churn_rate", F.when(F.col("updated") > 0, F.round(F.col("churned") / F.col("updated"), 3)))
