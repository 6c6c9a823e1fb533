"""Roll-ups and selections over the visit log; every function takes visit records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["tendable_type", "tendable_id"]


def applied(visits: DataFrame) -> DataFrame:
    """Visits that ended well and were applied."""
    return visits.where("status = 'succeeded' AND applied")


def since(rows: DataFrame, start: datetime, column: str = "created_at", inclusive: bool = True) -> DataFrame:
    at = F.lit(start).cast("timestamp_ntz")
    return rows.where(F.col(column) >= at if inclusive else F.col(column) > at)


def confidence_bin(confidence: Column) -> Column:
    """'nil' or one of five bins of 0.2, closed below; the last holds everything from 0.8."""
    label = F.when(confidence.isNull(), "nil")
    for upper, name in ((0.2, "0.0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8")):
        label = label.when(confidence < upper, name)
    return label.otherwise("0.8-1.0")


def named(column: str) -> Column:
    """The text, or 'unknown' for null and blank."""
    return F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "unknown").otherwise(F.col(column))


def ratio(part: Column, whole: Column) -> Column:
    """A share rounded to three places, 0.0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 3))


def report(visits: DataFrame) -> DataFrame:
    """facet, total, escalated, final_total, empty_final and their rates, in one aggregation."""
    final = F.expr("status = 'succeeded' AND applied")
    wrote = F.expr("coalesce(n_added, 0) + coalesce(n_updated, 0) + coalesce(n_deleted, 0)")
    counted = visits.groupBy("facet").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("escalation_step") > 0).alias("escalated"),
        F.count_if(final).alias("final_total"),
        F.count_if(final & (wrote == 0)).alias("empty_final"),
    )
    return counted.withColumns({"escalation_rate": ratio(F.col("escalated"), F.col("total")), "empty_final_rate": ratio(F.col("empty_final"), F.col("final_total"))})


def mix(visits: DataFrame, dimensions: dict[str, Column], by: str = "facet") -> DataFrame:
    """by, dimension, label, n: counts of several labellings at once, from one scan and one exchange."""
    labels = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), c.alias("label")) for d, c in dimensions.items()))).alias("x")
    return visits.select(by, labels).groupBy(by, "x.dimension", "x.label").agg(F.count("*").alias("n"))


def spend(visits: DataFrame) -> DataFrame:
    """facet, tier, tokens in, out and total; the rows with a null tier are the facets' totals."""
    shaped = visits.select("facet", named("tier").alias("tier"), *(F.coalesce(f"tokens_{k}", F.lit(0)).alias(k) for k in ("input", "output", "total")))
    sums = [F.sum(k).cast("bigint").alias(f"tokens_{k}") for k in ("input", "output", "total")]
    return shaped.groupingSets([["facet", "tier"], ["facet"]], "facet", "tier").agg(*sums)


def estimates(visits: DataFrame, window: int = 50, default: int = 4000) -> DataFrame:
    """facet, est: tokens of the last `window` visits that succeeded over those applied among them.

    A facet without applied visits or tokens takes the whole log's figure, and that
    `default`. Integer division, at least 1.
    """
    good = visits.where("status = 'succeeded'").select("facet", "created_at", "id", "tokens_total", "applied")
    newest = [F.col("created_at").desc(), F.col("id").desc()]

    def over(rows: DataFrame, *by: str) -> DataFrame:
        sums = rows.groupBy(*by).agg(F.sum(F.coalesce("tokens_total", F.lit(0))).alias("t"), F.count_if("applied").alias("a"))
        return sums.select(*by, F.when((F.col("a") > 0) & (F.col("t") > 0), F.greatest(F.expr("t div a"), F.lit(1))).alias("est"))

    last = good.withColumn("rn", F.row_number().over(Window.partitionBy("facet").orderBy(*newest))).where(F.col("rn") <= window)
    own, whole = over(last, "facet"), over(good.orderBy(*newest).limit(window)).withColumnRenamed("est", "all_est")
    facets = visits.select("facet").distinct()
    joined = facets.alias("f").join(own.alias("o"), F.col("f.facet").eqNullSafe(F.col("o.facet")), "left").join(F.broadcast(whole), F.lit(True))  # one row
    return joined.select("f.facet", F.coalesce("o.est", "all_est", F.lit(default)).cast("bigint").alias("est"))


def last_tended(visits: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """keys..., last_finished: when each was last finished, of applied visits."""
    return applied(visits).groupBy(*keys).agg(F.max("finished_at").alias("last_finished"))


def frontier(memberships: DataFrame, visits: DataFrame, facet: str, retry_after: datetime | None = None) -> DataFrame:
    """Members never read on `facet` in their context; with `retry_after`, without those that failed later than that.

    Both exclusions are left anti joins on context and record, all contexts at once.
    """
    own = visits.where(F.col("facet") == facet)
    same = F.expr("m.context_id = v.context_id AND m.member_type = v.tendable_type AND m.member_id = v.tendable_id")
    key = ["context_id", *RECORD]
    left = memberships.alias("m").join(applied(own).select(*key).alias("v"), same, "left_anti")
    if retry_after is not None:
        failed = since(own.where("status = 'failed'"), retry_after, inclusive=False).select(*key)
        left = left.alias("m").join(failed.alias("v"), same, "left_anti")
    return left


def lanes(memberships: DataFrame, facets: DataFrame, hosts: DataFrame) -> DataFrame:
    """facet, context_id, member_type, member_id, created_at: what each lane is to read: the members of its context, in the root lane (null) all host records, which have no date.

    `memberships` and `hosts` (record) have no repeats; `facets` has one row for each facet.
    """
    root = hosts.select(F.lit(None).cast("bigint").alias("context_id"), F.col("tendable_type").alias("member_type"), F.col("tendable_id").alias("member_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return memberships.select("context_id", "member_type", "member_id", "created_at").unionByName(root).join(facets.select("facet"), F.lit(True))


def frontier_lanes(wanted: DataFrame, visits: DataFrame, retry_after: datetime | None = None) -> DataFrame:
    """The rows of `lanes` never read; with `retry_after`, without those that failed in their lane later than that.

    One left anti join with facet in the key for all lanes; a null context is the
    root lane, which only its own visits clear.
    """
    key = ["facet", "context_id", *RECORD]
    gone = applied(visits).select(*key)
    if retry_after is not None:
        gone = gone.unionByName(since(visits.where("status = 'failed'"), retry_after, inclusive=False).select(*key))
    same = F.expr("m.facet <=> v.facet AND m.context_id <=> v.context_id AND m.member_type = v.tendable_type AND m.member_id = v.tendable_id")
    return wanted.alias("m").join(gone.alias("v"), same, "left_anti")


def neighborhood(visits: DataFrame, threshold: int, cooldown: datetime) -> DataFrame:
    """context_id, facet, record, behind: records with at least `threshold` visits of their lane after their own last, which is older than `cooldown`.

    A lane's order needs one sort by lane; a record's place is its last visit's. The
    running count over a lane comes from the counts of its days, so that a lane of
    very many visits is ordered by day and not in one task.
    """
    lane = ["context_id", "facet"]
    held = applied(visits).where("context_id IS NOT NULL AND created_at IS NOT NULL").select(*lane, *RECORD, "created_at", "id", F.to_date("created_at").alias("day"))
    days = held.groupBy(*lane, "day").agg(F.count("*").alias("n"))
    after = Window.partitionBy(*lane).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = days.select(*lane, "day", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("later"))
    within = Window.partitionBy(*lane, "day").orderBy(F.col("created_at").desc(), F.col("id").desc())
    placed = held.withColumn("place", F.row_number().over(within) - 1).join(later, [*lane, "day"])
    behind = placed.groupBy(*lane, *RECORD).agg(F.min(F.col("place") + F.col("later")).cast("bigint").alias("behind"), F.max("created_at").alias("last_at"))
    return behind.where((F.col("behind") >= threshold) & (F.col("last_at") < F.lit(cooldown).cast("timestamp_ntz"))).drop("last_at")


def stale(visits: DataFrame, before: datetime) -> DataFrame:
    """context_id, facet, record, last_started: what was last started before `before`, by lane."""
    last = applied(visits).groupBy("context_id", "facet", *RECORD).agg(F.max("started_at").alias("last_started"))
    return last.where(F.col("last_started") < F.lit(before).cast("timestamp_ntz"))


def source_changes(visits: DataFrame, sources: DataFrame, clock: str) -> DataFrame:
    """facet, record, last_started, changed_at: records whose source is newer than their last reading on a facet."""
    last = applied(visits).groupBy("facet", *RECORD).agg(F.max("started_at").alias("last_started"))
    newest = sources.groupBy(*RECORD).agg(F.max(clock).alias("changed_at"))
    return last.join(newest, RECORD).where("changed_at > last_started")


def per_day(visits: DataFrame) -> DataFrame:
    """day, visits, failed, tokens."""
    return visits.where("created_at IS NOT NULL").groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("visits"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens")
    )


def cadence(visits: DataFrame, last: int = 8) -> DataFrame:
    """beats, mean_gap_hours: the mean gap between the starts of the `last` newest cycles."""
    beats = visits.where("heartbeat_id IS NOT NULL AND created_at IS NOT NULL").groupBy("heartbeat_id").agg(F.min("created_at").alias("at"))
    newest = beats.orderBy(F.col("at").desc(), F.col("heartbeat_id").desc()).limit(last)
    gap = F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))
    return newest.agg(F.count("*").alias("beats"), F.when(F.count("*") > 1, F.round(gap / 3.6e9 / (F.count("*") - 1), 3)).alias("mean_gap_hours"))


def recently_tended(visits: DataFrame, scan: int = 40, show: int = 8) -> DataFrame:
    """record, last_at: the newest `show` different records among the newest `scan` applied visits."""
    newest = applied(visits).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(scan)
    return newest.groupBy(*RECORD).agg(F.max("created_at").alias("last_at")).orderBy(F.col("last_at").desc_nulls_last(), *RECORD).limit(show)


def chain_tokens(visits: DataFrame, forest: DataFrame) -> DataFrame:
    """root_id, visits, steps, tokens: each promotion chain's cost, by the roots of its hierarchy.

    Visits in no chain are chains of one.
    """
    rooted = visits.alias("v").join(forest.where("NOT cyclic").alias("f"), F.expr("v.id = f.id"), "left")
    root = F.coalesce("f.root", "v.id").alias("root_id")
    return rooted.select(root, F.coalesce("f.depth", F.lit(0)).alias("depth"), "v.tokens_total").groupBy("root_id").agg(
        F.count("*").alias("visits"), F.max("depth").cast("bigint").alias("steps"), F.coalesce(F.sum("tokens_total"), F.lit(0)).cast("bigint").alias("tokens")
    )


def numbered(visits: DataFrame, last: int = 50) -> DataFrame:
    """The `last` newest applied visits of each record and facet with `pass`, counted from the oldest of them.

    The sort reads each group once and keeps its newest.
    """
    key = [*RECORD, "facet"]
    newest = Window.partitionBy(*key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    kept = applied(visits).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)
    sizes = Window.partitionBy(*key).orderBy("back").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return kept.withColumn("pass", (F.max("back").over(sizes) - F.col("back") + 1).cast("bigint"))


def passes(visits: DataFrame, last: int = 50) -> DataFrame:
    """pass, visits, added, updated, deleted, noop, mean_confidence, novel_rate over the n-th readings of records on facets."""
    sums = {k: F.sum(F.coalesce(f"n_{k}", F.lit(0))).cast("bigint").alias(k) for k in ("added", "updated", "deleted", "noop")}
    totals = numbered(visits, last).groupBy("pass").agg(F.count("*").alias("visits"), *sums.values(), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    ops = F.expr("added + updated + deleted + noop")
    return totals.withColumn("novel_rate", F.when(ops > 0, F.round(F.col("added") / ops, 6)))
