"""Claims: which are live, now or at a time, what stands behind them, and how states differ."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import plain_value
from claimgraph.operators import audits as verdicts

RECORD = ["tendable_type", "tendable_id"]
#: Two writings more alike than this are churn, not news.
CHURN = 0.85


def live() -> Column:
    return F.expr("superseded_by_id IS NULL AND coalesce(status, '') <> 'superseded'")


def understanding() -> Column:
    """Claims that a visit or a person made."""
    return F.expr("visit_id IS NOT NULL OR attributed_to LIKE 'human%'")


def warrant(claims: DataFrame, audits: DataFrame) -> DataFrame:
    """`claims` with `warrant`: superseded, else what the effective verdict says, else a person behind a locked claim, else the status."""
    judged = verdicts.effective(audits).select(F.col("claim_id").alias("__claim"), F.col("source").alias("__source"), F.col("verdict").alias("__verdict"))
    joined = claims.join(judged, F.col("id") == F.col("__claim"), "left")
    state = (
        F.when(F.col("status") == "superseded", "superseded")
        .when(F.expr("__source = 'human' AND __verdict = 'supported'"), "human_verified")
        .when(F.col("__verdict") == "supported", "examiner_supported")
        .when(F.col("__verdict").isin("unsupported", "contradicted"), "contradicted")
        .when(F.expr("locked AND attributed_to LIKE 'human%'"), "human_verified")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("warrant", state).drop("__claim", "__source", "__verdict")


def state_at(claims: DataFrame, at: datetime | Column) -> DataFrame:
    """The claims live at an instant, given the whole log.

    A claim is live from its creation until its successor's; a successor that has no
    row never came. A claim withdrawn without a successor was live until it was last
    updated.
    """
    t = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    successors = claims.select(F.col("id").alias("__next"), F.col("created_at").alias("__ended"))
    joined = claims.where(F.col("created_at") <= t).join(successors, F.col("superseded_by_id") == F.col("__next"), "left")
    held = F.when(F.col("superseded_by_id").isNotNull(), F.col("__next").isNull() | (F.col("__ended") > t)).when(F.col("status") == "superseded", F.col("updated_at") > t).otherwise(True)
    return joined.where(held).drop("__next", "__ended")


def bigrams(text: Column) -> Column:
    """Bigrams of the text in lower case with runs of white space as one space; none under two characters."""
    plain = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.when(F.length(plain) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substring(plain, i, F.lit(2))))


def similarities(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, similarity: the Dice coefficient of the bigram multisets of two texts; 1 for equal texts, 0 if one has no bigrams.

    Keys are unique. Bigrams are counted where their pair is: one exchange by key
    serves both groupings, and a pair's counts combine before it.
    """
    marked = lambda text, x, y: F.transform(bigrams(F.col(text)), lambda g: F.struct(g.alias("g"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    grams = pairs.select(key, F.inline(F.concat(marked(a, 1, 0), marked(b, 0, 1))))
    counts = grams.repartition(key).groupBy(key, "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    dice = counts.groupBy(key).agg((2.0 * F.sum(F.least("x", "y")) / (F.sum("x") + F.sum("y"))).alias("dice"))
    alike = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce("dice", F.lit(0.0)))
    return pairs.join(dice, key, "left").select(key, alike.alias("similarity"))


def successions(claims: DataFrame) -> DataFrame:
    """id, next_id, key, similarity, churn: each claim with its successor under the same key; strings are compared without their quotes."""
    after = claims.select(F.col("id").alias("next_id"), F.col("key").alias("__key"), F.col("value").alias("to_value"))
    joined = claims.where("superseded_by_id IS NOT NULL AND value IS NOT NULL").join(after, (F.col("superseded_by_id") == F.col("next_id")) & (F.col("key") == F.col("__key")))
    both = joined.where("to_value IS NOT NULL").select("id", "next_id", "key", plain_value(F.col("value")).alias("from_value"), plain_value(F.col("to_value")).alias("to_value"))
    alike = both.join(similarities(both, "id", "from_value", "to_value"), "id")
    return alike.select("id", "next_id", "key", "similarity", (F.col("similarity") > CHURN).alias("churn"))


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """record, key, kind, from_value, to_value: what two states differ in, the latest claim of a key standing for it."""
    key = [*RECORD, "key"]
    newest = F.struct("created_at", "id")
    one = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct("id", "value"), newest).alias("c"))
    same = F.expr(" AND ".join(f"b.{k} <=> a.{k}" for k in key))
    joined = one(before).alias("b").join(one(after).alias("a"), same, "full_outer")
    kind = F.when(F.col("b.c").isNull(), "added").when(F.col("a.c").isNull(), "deleted").when(F.expr("b.c.id <> a.c.id OR NOT (b.c.value <=> a.c.value)"), "changed")
    return joined.select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key), kind.alias("kind"), F.col("b.c.value").alias("from_value"), F.col("a.c.value").alias("to_value")).where("kind IS NOT NULL")


def excerpts(claims: DataFrame, texts: DataFrame, size: int = 220) -> DataFrame:
    """record, excerpt: the text of a summary-like live claim, else the longest string claim, else the record's source text.

    White space is squeezed and the text cut at `size` characters. `claims` needs a
    column `text`, null where the value is no string; `texts` has record and text.
    """
    liked = F.lower("key").rlike("summary|abstract|description|overview").cast("int")
    rank = F.struct(liked, F.when(liked == 0, F.length("text")).otherwise(0), (-F.col("id")).alias("first"))
    told = claims.where(live() & F.col("text").isNotNull() & (F.trim("text") != "")).groupBy(*RECORD).agg(F.max_by("text", rank).alias("told"))
    source = texts.where("text IS NOT NULL").groupBy(*RECORD).agg(F.min_by("text", F.col("doc_id")).alias("source"))
    joined = told.join(source, RECORD, "full_outer")
    return joined.select(*RECORD, F.left(F.trim(F.regexp_replace(F.coalesce("told", "source"), r"\s+", " ")), F.lit(size)).alias("excerpt"))


def tombstones(claims: DataFrame) -> DataFrame:
    """Claims withdrawn without a successor."""
    return claims.where("status = 'superseded' AND superseded_by_id IS NULL")


def reconcile(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """record, key, op, live_id, value: what each proposal does to the live claims.

    `proposed` has record, context_id, key, op, value and id, in whose order the
    proposals of a batch come: each meets what those before it under the same key have
    left. ADD always adds. UPDATE and NOOP without a live claim add, unless the value is
    blank; DELETE needs a live claim; a locked claim is neither updated nor deleted. A
    missing or unknown op is UPDATE where a claim lives, else ADD. One live claim stands
    for a key, the newest; `live_id` is null where an earlier proposal has replaced it.
    """
    key = [*RECORD, "context_id", "key"]
    held = current.where(live()).groupBy(*key).agg(F.max_by(F.struct("id", "locked"), F.struct("created_at", "id")).alias("c"))
    joined = proposed.alias("p").join(held.alias("h"), F.expr(" AND ".join(f"p.{k} <=> h.{k}" for k in key)), "left")
    given = F.upper(F.trim("p.op"))
    blank = F.trim(F.coalesce("p.value", F.lit(""))).isin("", '""', "null", "[]", "{}")
    told = joined.select(*(f"p.{k}" for k in key), "p.id", "p.value", F.when(given.isin("ADD", "UPDATE", "DELETE", "NOOP"), given).alias("given"), blank.alias("blank"), F.col("h.c.id").alias("first_id"), F.coalesce("h.c.locked", F.lit(False)).alias("locked"))
    before = Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    added = F.coalesce(F.max((F.col("given") == "ADD").cast("int")).over(before), F.lit(0)) == 1
    told = told.withColumn("fixed", F.col("locked") & F.col("first_id").isNotNull() & ~added)
    # Whether a claim lives after a proposal: yes, no, or as before.
    after = F.when(F.col("given") == "DELETE", F.when(~F.col("fixed"), F.lit(False))).when(F.col("given").isNull() | (F.col("given") == "ADD") | ~F.col("blank"), F.lit(True))
    told = told.withColumn("after", after).withColumn("last", F.last("after", ignorenulls=True).over(before))
    here = F.coalesce("last", F.col("first_id").isNotNull())
    changed = F.max((F.col("after").isNotNull() & (~F.col("fixed") | F.col("given").eqNullSafe("ADD"))).cast("int")).over(before)
    asked = F.coalesce("given", F.when(here, "UPDATE").otherwise("ADD"))
    op = (
        F.when(asked == "ADD", "ADD")
        .when(here & F.col("fixed"), "NOOP")
        .when(asked == "DELETE", F.when(here, "DELETE").otherwise("NOOP"))
        .when(here, asked)
        .when(F.col("blank"), "NOOP")
        .otherwise("ADD")
    )
    live_id = F.when(F.coalesce(changed, F.lit(0)) == 0, F.col("first_id"))
    return told.select(*key, "id", op.alias("op"), live_id.alias("live_id"), "value")


def newest_per_key(claims: DataFrame) -> DataFrame:
    """The newest live claim of each record, context and key."""
    newest = Window.partitionBy(*RECORD, "context_id", "key").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return claims.where(live()).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
