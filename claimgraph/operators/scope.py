"""Context scopes: the closure of the context tree and the three ways of reading by it.

A null context is the root scope. A cumulative read of a context sees its own rows,
its ancestors' and the root's; an exact one only its own; a membership restricts
records, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators import hierarchy


def closure(contexts: DataFrame) -> DataFrame:
    """context_id, ancestor_id, depth: each context with itself (depth 0) and all above it, by tour intervals."""
    edges = contexts.select("id", F.col("parent_id").alias("parent"))
    above = hierarchy.descendants(hierarchy.forest(edges)).select(F.col("descendant").alias("context_id"), F.col("ancestor").alias("ancestor_id"), F.col("links").alias("depth"))
    own = contexts.where("id IS NOT NULL").select(F.col("id").alias("context_id"), F.col("id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("depth"))
    return own.unionByName(above)


def cumulative(rows: DataFrame, closed: DataFrame, context_id: int, column: str = "context_id") -> DataFrame:
    """The rows a read from `context_id` sees: its own, its ancestors' and the root's (null)."""
    seen = closed.where(F.col("context_id") == context_id).select(F.col("ancestor_id").alias("__scope"))
    return rows.where(F.col(column).isNull()).unionByName(rows.join(seen, F.col(column) == F.col("__scope"), "left_semi"))


def exact(context_id: int | None, column: str = "context_id") -> Column:
    """The lane predicate: null means the root lane only."""
    return F.col(column).eqNullSafe(F.lit(context_id))


def members(rows: DataFrame, memberships: DataFrame, context_id: int, kind: str = "tendable_type", ident: str = "tendable_id") -> DataFrame:
    """The rows of records that are members of the context."""
    held = memberships.where(F.col("context_id") == context_id).select(F.col("member_type").alias("__t"), F.col("member_id").alias("__i"))
    return rows.join(held, (F.col(kind) == F.col("__t")) & (F.col(ident) == F.col("__i")), "left_semi")


def deepest(placed: DataFrame, closed: DataFrame) -> DataFrame:
    """member_type, member_id, context_id: each member's deepest context, the smaller id among equals."""
    depths = closed.groupBy("context_id").agg(F.max("depth").alias("depth"))
    ranked = placed.join(depths, "context_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    best = F.max(F.struct("depth", (-F.col("context_id")).alias("least")))
    return ranked.groupBy("member_type", "member_id").agg((-best["least"]).alias("context_id"))


def to_parents(rows: DataFrame, parts: DataFrame, kind: str = "Enliterator::Part") -> DataFrame:
    """`rows` with a part's record replaced by the record it is a part of; a part without a parent stays itself.

    `parts` has id, record_type, record_id, one row for each part.
    """
    held = parts.select(F.col("id").cast("string").alias("__part"), F.col("record_type").alias("__type"), F.col("record_id").cast("string").alias("__id"))
    joined = rows.join(held, (F.col("tendable_type") == kind) & (F.col("tendable_id") == F.col("__part")), "left")
    return joined.withColumns({"tendable_type": F.coalesce("__type", "tendable_type"), "tendable_id": F.when(F.col("__type").isNotNull(), F.col("__id")).otherwise(F.col("tendable_id"))}).select(*rows.columns)


def nearest(closed: DataFrame, declared: DataFrame, value: str) -> DataFrame:
    """context_id, value, origin: for each context what the nearest context on its path, itself first, declares; contexts without any are left out.

    `declared` has context_id and the value, one row for each context.
    """
    told = declared.select(F.col("context_id").alias("origin"), value)
    held = closed.join(told, F.col("ancestor_id") == F.col("origin"))
    return held.groupBy("context_id").agg(F.min_by(F.struct(value, "origin"), "depth").alias("d")).select("context_id", f"d.{value}", "d.origin")
