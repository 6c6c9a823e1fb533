"""Condition of records by probes, piles of failures, and what reading has left undone."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["tendable_type", "tendable_id"]


def survey(rows: DataFrame, key: Sequence[str], probes: dict[str, tuple[Column, Column, bool]]) -> DataFrame:
    """key..., signature, band, score, checked: what the probes say of each row.

    A probe is (passes, code, gating); a null `passes` means it does not apply. The
    signature joins the failing 'probe:code' in order; a gating failure makes the
    row untendable (0), any other degraded (0.5), none sound (1).
    """
    failing = F.array(*(F.when(~ok, F.concat(F.lit(f"{name}:"), code)) for name, (ok, code, _) in probes.items()))
    gated = F.lit(False)
    for ok, _, gating in probes.values():
        if gating:
            gated = gated | F.coalesce(~ok, F.lit(False))
    checked = sum((ok.isNotNull().cast("int") for ok, _, _ in probes.values()), F.lit(0))
    codes = F.array_sort(F.filter(failing, lambda x: x.isNotNull()))
    band = F.when(gated, "untendable").when(F.size(codes) > 0, "degraded").otherwise("sound")
    score = F.when(gated, 0.0).when(F.size(codes) > 0, 0.5).otherwise(1.0)
    return rows.select(*key, F.nullif(F.array_join(codes, "+"), F.lit("")).alias("signature"), band.alias("band"), score.alias("score"), checked.alias("checked"))


def probed(rows: DataFrame, key: Sequence[str], probes: dict[str, tuple[Column, Column, bool]]) -> DataFrame:
    """key..., probe, passed, code: a row for each probe that applies, with the code of a failure."""
    sides = F.array(*(F.struct(F.lit(name).alias("probe"), ok.alias("passed"), F.when(~ok, code).alias("code")) for name, (ok, code, _) in probes.items()))
    return rows.select(*key, F.inline(sides)).where("passed IS NOT NULL")


def bands(surveyed: DataFrame) -> DataFrame:
    """band, n, mean_score: how the surveyed rows stand."""
    return surveyed.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def due(hosts: DataFrame, surveyed: DataFrame, most: int) -> DataFrame:
    """record, origin: what to survey next, at most `most`: records never surveyed, an equal quota for each type, what quotas leave going to types in order of name, then those surveyed longest ago.

    `surveyed` has record and computed_at. Within a type the order is that of the id.
    Only each type's first `most` records are ranked.
    """
    fresh = hosts.select(*RECORD).distinct().join(surveyed.select(*RECORD), RECORD, "left_anti")
    placed = fresh.withColumn("place", F.row_number().over(Window.partitionBy("tendable_type").orderBy("tendable_id"))).where(F.col("place") <= most)
    types = hosts.agg(F.greatest(F.floor(F.lit(most) / F.greatest(F.count_distinct("tendable_type"), F.lit(1))), F.lit(1)).alias("quota"))
    first = placed.crossJoin(F.broadcast(types)).withColumn("extra", (F.col("place") > F.col("quota")).cast("int"))  # one row
    never = first.orderBy("extra", "tendable_type", "place").limit(most).select(*RECORD, F.lit("never").alias("origin"), F.lit(0).alias("part"), F.lit(None).cast("timestamp_ntz").alias("at"))
    oldest = surveyed.groupBy(*RECORD).agg(F.max("computed_at").alias("at")).orderBy("at", *RECORD).limit(most).select(*RECORD, F.lit("stale").alias("origin"), F.lit(1).alias("part"), "at")
    return never.unionByName(oldest).orderBy("part", "at", *RECORD).limit(most).select(*RECORD, "origin")


def piles(rows: DataFrame, by: Sequence[str], ident: str, clock: str, samples: int = 3) -> DataFrame:
    """by..., n, samples: failures that look alike, with the newest of them by name."""
    newest = Window.partitionBy(*by).orderBy(F.col(clock).desc_nulls_last(), F.col(ident).desc())
    first = rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= samples)
    named = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(ident).cast("string").alias("i")))), lambda x: x["i"]), ",").alias("samples"))
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    return counted.alias("c").join(named.alias("s"), same).select("c.*", "s.samples")


def sightings(before: DataFrame, now: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., known, n, changed: piles now against those seen before (null where there is none); a pile that is new, gone or of another size has changed. Both have by and n; nulls in `by` are equal."""
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}"))
    b, a = before.withColumn("__there", F.lit(True)).alias("b"), now.withColumn("__there", F.lit(True)).alias("a")
    key = [F.when(F.col("a.__there"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in by]
    return b.join(a, same, "full_outer").select(*key, F.col("b.n").alias("known"), F.col("a.n").alias("n"), (~F.col("a.n").eqNullSafe(F.col("b.n"))).alias("changed"))


def residue(visits: DataFrame, claims: DataFrame, memberships: DataFrame, least: int) -> DataFrame:
    """record, visits: members that were read at least `least` times and have no live claim."""
    read = visits.where("status = 'succeeded' AND applied").groupBy(*RECORD).agg(F.count("*").alias("visits")).where(F.col("visits") >= least)
    bare = read.join(claims.where("superseded_by_id IS NULL AND coalesce(status, '') <> 'superseded'").select(*RECORD), RECORD, "left_anti")
    placed = memberships.select(F.col("member_type").alias("tendable_type"), F.col("member_id").alias("tendable_id"))
    return bare.join(placed, RECORD, "left_semi")


def not_since(visits: DataFrame, at: datetime) -> DataFrame:
    """record, facet: what was read before an instant and not again since."""
    t = F.lit(at).cast("timestamp_ntz")
    key = [*RECORD, "facet"]
    read = visits.where("status = 'succeeded' AND applied")
    return read.where(F.col("created_at") < t).select(*key).distinct().join(read.where(F.col("created_at") >= t).select(*key), key, "left_anti")


def drawn(rows: DataFrame, key: str, by: str, n: int, seed: str) -> DataFrame:
    """`n` rows of each group in the order of a seeded hash: the same ones every time."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def calibration(audits: DataFrame) -> DataFrame:
    """source, verdict, n, mean_confidence, spread, brier: how far stated confidence is from the verdict; the rows with a null verdict are the sources'.

    Unverifiable verdicts and null confidences are left out.
    """
    miss = F.pow(F.col("confidence") - F.when(F.col("verdict") == "supported", 1.0).otherwise(0.0), F.lit(2))
    held = audits.where("confidence IS NOT NULL AND verdict <> 'unverifiable'").select("source", "verdict", "confidence", miss.alias("miss"))
    return held.groupingSets([["source", "verdict"], ["source"]], "source", "verdict").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.stddev_pop("confidence"), 4).alias("spread"), F.round(F.avg("miss"), 4).alias("brier")
    )


def difference(current: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """key..., change: 'insert' what is wanted and missing, 'delete' what is there and not wanted."""
    both = current.select(*key).distinct().withColumn("c", F.lit(1)).join(wanted.select(*key).distinct().withColumn("w", F.lit(1)), list(key), "full_outer")
    return both.where("c IS NULL OR w IS NULL").select(*key, F.when(F.col("c").isNull(), "insert").otherwise("delete").alias("change"))


def unreferenced(rows: DataFrame, key: str, *users: DataFrame) -> DataFrame:
    """The rows whose key no user has in its first column."""
    left = rows
    for u in users:
        left = left.join(u.select(F.col(u.columns[0]).alias(key)).distinct(), key, "left_anti")
    return left
