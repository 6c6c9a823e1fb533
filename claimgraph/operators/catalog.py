"""Browsing a collection: overview, subject headings, subjects, pages, portraits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.operators.claims import live, understanding

RECORD = ["tendable_type", "tendable_id"]
# The longest term that can be a heading, keys that name their record, and the words by which a key tells its category.
LONGEST = 90
IDENTIFIER_KEY = r"(^|_)(number|no|id|code|doi|isbn|issn|identifier)(_|$)"
CHARTER_KEY = r"^charter_"


def host_types(visits: DataFrame, internal: str = "%::%") -> DataFrame:
    """tendable_type: the types in the visit log that are not internal ones, which have a namespace."""
    return visits.where(~F.col("tendable_type").like(internal)).select("tendable_type").distinct()


def corpus(visits: DataFrame, registered: list[str], masked: list[str]) -> DataFrame:
    """tendable_type: registered types and those in the visit log, without masked ones."""
    named = visits.sparkSession.createDataFrame([(t,) for t in registered], "tendable_type string")
    return host_types(visits).unionByName(named).distinct().where(~F.col("tendable_type").isin(*masked))


def overview(claims: DataFrame, memberships: DataFrame, visits: DataFrame) -> DataFrame:
    """measure, n: holdings, tended records, live claims and keys in use, as rows."""
    one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = [
        one("members", memberships.select("member_type", "member_id").distinct()),
        one("tended", visits.where("status = 'succeeded' AND applied").select(*RECORD).distinct()),
        one("live_claims", claims.where(live())),
        one("keys", claims.where(live() & understanding()).select("key").distinct()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heading_terms(value: Column) -> Column:
    """The strings of a JSON string or array, byte for byte, that are not blank and not too long; no objects, no numbers."""
    parsed = F.try_parse_json(value)
    items = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))
    texts = F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), lambda t: t.isNotNull())
    return F.filter(texts, lambda t: (F.trim(F.regexp_replace(t, r"\s", " ")) != "") & (F.length(t) <= LONGEST))


def headed(claims: DataFrame) -> DataFrame:
    """record, key, term: live understanding claims by their heading terms, each once a record."""
    held = claims.where(live() & understanding()).where(~F.col("key").rlike(IDENTIFIER_KEY) & ~F.col("key").rlike(CHARTER_KEY))
    return held.select(*RECORD, "key", F.explode(heading_terms(F.col("value"))).alias("term")).distinct()


def headings(claims: DataFrame, keys: int = 8, values: int = 10) -> DataFrame:
    """key, term, records, place: the commonest terms of the keys that most records have.

    All rows count, without a scan bound. A key whose terms are all single and more
    than are shown is no heading.
    """
    terms = headed(claims)
    counted = terms.groupBy("key", "term").agg(F.count("*").alias("records"))
    whole = counted.groupBy("key").agg(F.max("records").alias("most"), F.count("*").alias("n_terms"))
    held = terms.select("key", *RECORD).distinct().groupBy("key").agg(F.count("*").alias("key_records"))
    shown = whole.join(held, "key").where((F.col("most") > 1) | (F.col("n_terms") <= values)).orderBy(F.col("key_records").desc(), "key").limit(keys).select("key")
    ranked = counted.join(F.broadcast(shown), "key").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.col("records").desc(), "term")))  # at most `keys` rows
    return ranked.where(F.col("place") <= values)


def subject(claims: DataFrame, key: str, term: str) -> DataFrame:
    """The records filed under a heading: as many as the heading counts."""
    return headed(claims.where(F.col("key") == key)).where(F.col("term") == term).select(*RECORD)


def page(rows: DataFrame, number: int, size: int = 24, by: str = "id") -> DataFrame:
    """One page in accession order, newest first; a number under 1 is 1."""
    return rows.orderBy(F.col(by).desc()).offset((max(number, 1) - 1) * size).limit(size)


def portrait(claims: DataFrame, visits: DataFrame, samples: int = 3) -> DataFrame:
    """facet, key, live_claims, records, sample: what each facet's visits have left, with the first of `samples` values by id."""
    lanes = visits.select(F.col("id").alias("visit_id"), "facet")
    held = claims.where(live() & F.col("visit_id").isNotNull()).join(lanes, "visit_id")
    ranked = held.withColumn("n", F.row_number().over(Window.partitionBy("facet", "key").orderBy("id")))
    first = ranked.where(F.col("n") <= samples).groupBy("facet", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.coalesce("value", F.lit("null")).alias("v")))), lambda x: x["v"]), " | ").alias("sample"))
    counts = held.groupBy("facet", "key").agg(F.count("*").alias("live_claims"), F.count_distinct(*RECORD).alias("records"))
    return counts.join(first, ["facet", "key"])


def cards(claims: DataFrame, visits: DataFrame, memberships: DataFrame) -> DataFrame:
    """record, live_claims, visits, last_at, contexts: every record's card, from sides that are aggregated before they meet."""
    told = claims.where(live()).groupBy(*RECORD).agg(F.count("*").alias("live_claims"))
    read = visits.where("status = 'succeeded' AND applied").groupBy(*RECORD).agg(F.count("*").alias("visits"), F.max("finished_at").alias("last_at"))
    placed = memberships.groupBy(F.col("member_type").alias("tendable_type"), F.col("member_id").alias("tendable_id")).agg(F.count_distinct("context_id").alias("contexts"))
    joined = told.join(read, RECORD, "full_outer").join(placed, RECORD, "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select(*RECORD, *(F.coalesce(c, zero).alias(c) for c in ("live_claims", "visits", "contexts")), "last_at")


def context_stats(contexts: DataFrame, memberships: DataFrame, claims: DataFrame, visits: DataFrame) -> DataFrame:
    """id, members, live_claims, visits of each context."""
    out = contexts.select("id")
    sides = {"members": memberships.select("context_id", "member_type", "member_id").distinct(), "live_claims": claims.where(live()), "visits": visits.where("status = 'succeeded' AND applied")}
    for name, rows in sides.items():
        counts = rows.groupBy(F.col("context_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return out


def completeness(records: DataFrame, claims: DataFrame, visits: DataFrame, memberships: DataFrame) -> DataFrame:
    """record, score: the mean of three marks - has a live claim, was read, stands in a context."""
    flagged = records.select(*RECORD).distinct()
    sides = [
        claims.where(live()).select(*RECORD),
        visits.where("status = 'succeeded' AND applied").select(*RECORD),
        memberships.select(F.col("member_type").alias("tendable_type"), F.col("member_id").alias("tendable_id")),
    ]
    for i, rows in enumerate(sides):
        flagged = flagged.join(rows.distinct().withColumn(f"m{i}", F.lit(1)), RECORD, "left")
    return flagged.select(*RECORD, F.round((F.coalesce("m0", F.lit(0)) + F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))) / 3, 6).alias("score"))
