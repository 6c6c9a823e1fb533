"""What to read next within a budget of tokens.

Candidates are counted, dealt to and ranked in Spark; only totals come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.sources import stage

#: So many lanes at most are dealt to where the budget buys no lane its share.
MOST_LANES = 10_000


def greedy(lanes: Sequence[tuple[int, int]], budget: int) -> list[int]:
    """How many candidates each lane (candidates, cost) gets if lanes take all they can afford, one after the other."""
    out = []
    for n, cost in lanes:
        take = min(n, max(budget, 0) // cost)
        out.append(take)
        budget -= take * cost
    return out


def fair(lanes: Sequence[tuple[int, int]], budget: int) -> list[int]:
    """The same with equal shares: what lanes leave of theirs is shared out once more among those with candidates left.

    If a share is too small for any lane's cost, the budget is dealt greedily instead.
    """
    if not lanes or budget <= 0:
        return [0] * len(lanes)
    share = budget // len(lanes)
    out = [min(n, share // cost) for n, cost in lanes]
    hungry = [i for i, (n, _) in enumerate(lanes) if 0 < out[i] < n]
    left = budget - sum(k * cost for k, (_, cost) in zip(out, lanes, strict=True))
    if hungry and left > 0:
        for i in hungry:
            n, cost = lanes[i]
            out[i] += min(n - out[i], left // len(hungry) // cost)
    return out if any(out) else greedy(lanes, budget)


def first_reason(items: DataFrame, key: Sequence[str], rank: Column) -> DataFrame:
    """One row for each item that several triggers ask for: that of the first reason."""
    once = Window.partitionBy(*key).orderBy(rank)
    return items.withColumn("__r", F.row_number().over(once)).where("__r = 1").drop("__r")


def takes(counts: DataFrame, lane: str, budget: int) -> DataFrame:
    """lane, take: how many candidates each lane gets of equal shares, as `fair` deals them, for any number of lanes; `counts` has lane, n and cost.

    If no share buys anything, the lanes in the order of their names take what they
    can afford; as each of them costs more than its share, no more than there are
    shares in a budget can, and only the lanes that come first are dealt to.
    """
    known = stage(counts.select(lane, "n", "cost"))
    lanes = max(known.rows, 1)
    share = budget // lanes
    first = F.least(F.col("n"), F.floor(F.lit(share) / F.col("cost"))).cast("bigint")
    dealt = known.df.withColumn("first", first)
    hungry = F.expr("first > 0 AND first < n")
    sums = dealt.agg(F.count_if(hungry).alias("hungry"), F.coalesce(F.sum(F.col("first") * F.col("cost")), F.lit(0)).alias("spent"), F.coalesce(F.max("first"), F.lit(0)).alias("most")).first()
    if not sums["most"]:
        some = known.df.orderBy(lane).limit(MOST_LANES).collect()
        taken = greedy([(r.n, r.cost) for r in some], budget)
        kind = counts.schema[lane].dataType.simpleString()
        return counts.sparkSession.createDataFrame([(r[lane], t) for r, t in zip(some, taken, strict=True) if t], f"{lane} {kind}, take bigint")
    each = max(budget - sums["spent"], 0) // max(sums["hungry"], 1)
    more = F.when(hungry, F.least(F.col("n") - F.col("first"), F.floor(F.lit(each) / F.col("cost")))).otherwise(0).cast("bigint")
    return dealt.select(lane, (F.col("first") + more).alias("take")).where("take > 0")


def planned(candidates: DataFrame, lane: str, cost: str, order: Sequence[Column], budget: int) -> DataFrame:
    """The candidates that the budget affords, with their `place` in their lane.

    `cost` is a lane's cost of one item, the same in all of its rows and at least 1. No
    lane is dealt more than its take: ranks beyond that are dropped before the exchange. The candidates are
    written once, as they are counted and then ranked.
    """
    candidates = stage(candidates).df
    counts = candidates.groupBy(lane).agg(F.count("*").alias("n"), F.max(cost).alias("cost"))
    dealt = takes(counts, lane, budget)
    most = max(dealt.agg(F.coalesce(F.max("take"), F.lit(0)).alias("m")).first()["m"], 1)
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).where(F.col("place") <= most)
    kept = ranked.alias("c").join(dealt.alias("d"), F.col(f"c.{lane}").eqNullSafe(F.col(f"d.{lane}")) & (F.col("c.place") <= F.col("d.take")))
    return kept.select("c.*")
