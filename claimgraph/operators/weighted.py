"""Per-key results from compressed value frequencies, so that no hot key is one task's work."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.sources.shared import stage


def frequencies(rows: DataFrame, keys: Sequence[str], value: str | Column, weight: Column | None = None) -> DataFrame:
    """keys..., value, weight: how often each value occurs under each key.

    The first of the two groupings. Rows of a hot key spread over its values, and
    equal pairs are combined before the exchange.
    """
    value = F.col(value) if isinstance(value, str) else value
    shaped = rows.select(*keys, value.alias("value"))
    count = F.count("*") if weight is None else F.sum(weight)
    return shaped.groupBy(*keys, "value").agg(count.alias("weight"))


def profile(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., n, n_null, n_distinct, mode: exact per-key results of `frequencies`.

    `n` counts all rows, `n_distinct` the values that are not null, `mode` is the
    most frequent value that is not null, the smallest of equally frequent ones
    (null if there is none). All of them combine on the map side, so that a key
    sends one row from each task, however many rows or values it has.
    """
    held = F.col("value").isNotNull()
    return weighted.groupBy(*keys).agg(
        F.sum("weight").alias("n"),
        F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0)).cast("long").alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min(F.when(held, F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))["v"].alias("mode"),
    )


def percentiles(weighted: DataFrame, keys: Sequence[str], shares: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """keys..., one column for each share: the exact discrete percentile of the weighted values.

    The percentile of share p is the smallest value at which the running weight
    reaches p of the key's weight. Nulls have no rank. The values are laid out by
    range over all tasks, so a key with many values spans several; a key's running
    weight is that of the ranges before plus that within its range, and the table of
    weights by key and range has at most one row for each key and range that it
    touches. Keys without values are left out.
    """
    names = list(names or (f"p{round(100 * s):d}" for s in shares))
    keys = list(keys)
    laid = weighted.where("value IS NOT NULL").select(*keys, "value", "weight").repartitionByRange(*keys, "value")
    # Written, because a range partitioning is drawn from a sample: its two uses must see one layout.
    parts = stage(laid.withColumn("part", F.spark_partition_id())).df
    sums = parts.groupBy(*keys, "part").agg(F.sum("weight").alias("w"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"), F.sum("w").over(whole).alias("total"))
    same = F.lit(True)
    for k in [*keys, "part"]:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = parts.alias("p").join(offsets.alias("o"), same).select("p.*", "o.base", "o.total")
    within = Window.partitionBy(*keys, "part").orderBy("value")
    running = joined.withColumn("upto", F.col("base") + F.sum("weight").over(within))
    # In whole numbers, as a share such as 0.55 is no exact double.
    exact = [Fraction(str(s)) for s in shares]
    picked = [F.min(F.when(F.col("upto") * s.denominator >= F.col("total") * s.numerator, F.col("value"))).alias(n) for s, n in zip(exact, names, strict=True)]
    return running.groupBy(*keys).agg(*picked)


def heavy(profiled: DataFrame, share_of: int) -> DataFrame:
    """The keys of `profile` that hold at least one in `share_of` of all rows."""
    total = profiled.agg(F.sum("n").alias("__total"))
    kept = profiled.join(F.broadcast(total), F.col("n") * share_of >= F.col("__total"))  # one row
    return kept.drop("__total")
