"""Nearest neighbours by cosine, exact, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in one block: a block is what a task holds beside its own rows.
BLOCK = 1024
#: Rows in one slice: with a block of queries, what a task holds, however many rows there are.
SLICE = 50_000


def knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """query, key, distance, place: the `k` nearest rows to each query, itself left out; the smaller key among equals.

    `queries` are rows of the same columns. They are cut into blocks; each block
    meets each partition of the rows once, as a matrix product that keeps the
    best `k`, so that only k rows for each query and partition travel. Vectors
    that are null, empty or all zero are near nothing and left out.
    """
    held = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    kind = vectors.schema[key].dataType.simpleString()
    asked = held(queries)
    parts = max(1, -(-asked.count() // BLOCK))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # about BLOCK rows each
    known = held(vectors)
    n = max(-(-known.count() // SLICE), 1)
    slices = known.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(n)))
    grid = packed.select("block", "queries", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("slice"))

    def block(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "id", "distance"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        rows = np.stack(right["v"].to_numpy()).astype(np.float64)
        size = np.linalg.norm(rows, axis=1)
        rows, ids = rows[size > 0] / size[size > 0, None], right["id"].to_numpy()[size > 0]
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        out = []
        for asked_block in left["queries"]:
            q_ids = np.array([x["id"] for x in asked_block])
            q = np.stack([np.asarray(x["v"], np.float64) for x in asked_block])
            norm = np.linalg.norm(q, axis=1)
            q_ids, q = q_ids[norm > 0], q[norm > 0] / norm[norm > 0, None]
            if not len(q) or not len(ids):
                continue
            far = np.round(1.0 - q @ rows.T, 9)
            far[q_ids[:, None] == ids[None, :]] = np.inf
            # The k smallest, of equal ones those of the smaller id, without a sort of all.
            last = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1, None]
            nearer, equal = far < last, far == last
            best = (nearer | equal & (equal.cumsum(axis=1) <= k - nearer.sum(axis=1, keepdims=True))) & np.isfinite(far)
            q_at, at = np.nonzero(best)
            out.append(pd.DataFrame({"query": q_ids[q_at], "id": ids[at], "distance": far[q_at, at]}))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    near = grid.groupBy("slice").cogroup(slices.groupBy("slice")).applyInPandas(block, f"query {kind}, id {kind}, distance double")
    return _best(near, k).withColumnRenamed("id", key)


def _best(near: DataFrame, k: int) -> DataFrame:
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")))
    return ranked.where(F.col("place") <= k)


def page(vectors: DataFrame, key: str, vector: str, queries: DataFrame, number: int, size: int = 24) -> DataFrame:
    """One page of `knn`, nearest first; a number under 1 is 1. Rows are filtered by type before."""
    first = (max(number, 1) - 1) * size
    return knn(vectors, key, vector, queries, first + size).where(F.col("place") > first)
