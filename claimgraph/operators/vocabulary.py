"""Roll-ups of proposed vocabulary keys: what is asked for, what became of it, what stands for what.

Suggestions have id, record, facet, proposed_key, status, mapped_to, created_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["tendable_type", "tendable_id"]
STATUSES = ("approved", "mapped", "pending", "rejected")


def gaps(suggestions: DataFrame) -> DataFrame:
    """facet, proposed_key, records, occurrences, first_id: pending keys by how many records ask for them."""
    return suggestions.where("status = 'pending'").groupBy("facet", "proposed_key").agg(F.count_distinct(*RECORD).alias("records"), F.count("*").alias("occurrences"), F.min("id").alias("first_id"))


def pressure(suggestions: DataFrame) -> DataFrame:
    """proposed_key, pressure, records, resurged, top_facet: open keys, and how often they came again after their latest verdict."""
    verdicts = suggestions.where("status <> 'pending'").groupBy("proposed_key").agg(F.max("updated_at").alias("cut"))
    pending = suggestions.where("status = 'pending'")
    joined = pending.join(verdicts, "proposed_key", "left")
    totals = joined.groupBy("proposed_key").agg(F.count("*").alias("pressure"), F.count_distinct(*RECORD).alias("records"), F.count_if(F.expr("created_at > cut")).alias("resurged"))
    facets = pending.groupBy("proposed_key", "facet").agg(F.count("*").alias("n"))
    top = facets.groupBy("proposed_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "facet"))["facet"].alias("top_facet"))
    return totals.join(top, "proposed_key")


def rings(suggestions: DataFrame, wide: int = 3) -> DataFrame:
    """preferred, variants, n_variants, facets, dumping_ground: approved keys and those mapped to them; one that many facets use may be a dumping ground."""
    mapped = suggestions.where("status = 'mapped' AND mapped_to IS NOT NULL").select(F.col("mapped_to").alias("preferred"), F.col("proposed_key").alias("variant"), "facet")
    own = suggestions.where("status = 'approved'").select(F.col("proposed_key").alias("preferred"), F.lit(None).cast("string").alias("variant"), "facet")
    grouped = mapped.unionByName(own).groupBy("preferred").agg(F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"), F.count_distinct("variant").alias("n_variants"), F.count_distinct("facet").alias("facets"))
    return grouped.withColumn("dumping_ground", F.col("facets") >= wide)


def status_pivot(suggestions: DataFrame) -> DataFrame:
    """facet and the number of suggestions of each status."""
    wide = suggestions.groupBy("facet").pivot("status", list(STATUSES)).count()
    return wide.select("facet", *(F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in STATUSES))


def newest_verdicts(suggestions: DataFrame) -> DataFrame:
    """proposed_key, status, mapped_to: the latest verdict on each key."""
    newest = Window.partitionBy("proposed_key").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    return suggestions.where("status <> 'pending'").withColumn("n", F.row_number().over(newest)).where("n = 1").select("proposed_key", "status", "mapped_to")


def additions(suggestions: DataFrame) -> DataFrame:
    """facet, additions: the approved keys of each facet in order, what its contract gains."""
    approved = suggestions.where("status = 'approved' AND proposed_key IS NOT NULL")
    return approved.groupBy("facet").agg(F.array_join(F.array_sort(F.collect_set("proposed_key")), ",").alias("additions"))


def synonyms(suggestions: DataFrame) -> DataFrame:
    """facet, proposed_key, mapped_to: the different foldings of a key onto another."""
    return suggestions.where("status = 'mapped'").select("facet", "proposed_key", "mapped_to").distinct()


def resolved(suggestions: DataFrame) -> DataFrame:
    """proposed_key: keys with any verdict; for a context, pass what scope.cumulative sees from it."""
    return suggestions.where("status <> 'pending'").select("proposed_key").distinct()


def metrics(suggestions: DataFrame) -> DataFrame:
    """distinct_keys, preferred_terms, variant_keys, proliferation, one_off_keys, one_off_pct, over all statuses, in one row.

    Variants are counted once for each term they are folded onto; a one-off is asked
    for by one record. Proliferation is null without preferred terms.
    """
    per_key = suggestions.groupBy("proposed_key").agg(
        F.count_distinct(F.concat("tendable_type", F.lit(":"), "tendable_id")).alias("n"),
        F.max(F.expr("status = 'approved'")).alias("approved"),
        F.count_distinct(F.when(F.col("status") == "mapped", F.col("mapped_to"))).alias("targets"),
    )
    named = F.col("proposed_key").isNotNull()
    counted = per_key.agg(
        F.count("*").alias("distinct_keys"),
        F.count_if(named & F.col("approved")).alias("preferred_terms"),
        F.coalesce(F.sum(F.when(named, F.col("targets"))), F.lit(0)).cast("bigint").alias("variant_keys"),
        F.count_if(F.col("n") == 1).alias("one_off_keys"),
    )
    some = lambda whole, value: F.when(F.col(whole) > 0, value)
    rates = {"proliferation": some("preferred_terms", F.round(F.col("variant_keys") / F.col("preferred_terms"), 2)), "one_off_pct": some("distinct_keys", F.round(100.0 * F.col("one_off_keys") / F.col("distinct_keys")).cast("bigint"))}
    return counted.withColumns(rates)


def candidates(suggestions: DataFrame, most: int) -> DataFrame:
    """facet, proposed_key, demand, first_at, place: pending keys without any verdict, by how many records ask for them, at most `most` a facet; `first_at` is that of the first suggestion by id."""
    asked = suggestions.where("status = 'pending'").groupBy("facet", "proposed_key").agg(F.count_distinct(F.struct(*RECORD)).alias("demand"), F.min_by("created_at", "id").alias("first_at"))
    fresh = asked.join(resolved(suggestions), "proposed_key", "left_anti")
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("demand").desc(), "proposed_key"))
    return fresh.select("facet", "proposed_key", "demand", "first_at", place.alias("place")).where(F.col("place") <= most)


def evidence(suggestions: DataFrame, most: int) -> DataFrame:
    """proposed_key, tendable_id, facet, place: who asked for a key, each record and facet once, the first `most` by id."""
    once = suggestions.groupBy("proposed_key", "tendable_id", "facet").agg(F.min("id").alias("id"))
    return once.select("proposed_key", "tendable_id", "facet", F.row_number().over(Window.partitionBy("proposed_key").orderBy("id")).alias("place")).where(F.col("place") <= most)


def overlay(own: DataFrame, approved: DataFrame) -> DataFrame:
    """facet, key, origin: a facet's own keys and the approved ones; a key that is both is its own. Both have facet and key."""
    mine, theirs = own.distinct().withColumn("o", F.lit("own")), approved.distinct().withColumn("a", F.lit("approved"))
    return mine.join(theirs, ["facet", "key"], "full_outer").select("facet", "key", F.coalesce("o", "a").alias("origin"))
