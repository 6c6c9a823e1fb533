"""Filling containers of fixed capacity, by best fit in each partition and a tree of merges.

Each partition packs its own items by best fit, largest first. Containers that are
nearly full are done. The others travel on as items of their load to a level with
fewer partitions, a branch of neighbouring ones to each, where best fit joins them,
and so on until one partition is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.sources import stage

#: A container is nearly full, and done, when at most this share of it is free.
NEARLY = 1 / 128
#: Partitions that come together on the next level, and the most containers a merging task is given.
FAN_IN, TASK_ROWS = 8, 500_000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: largest first, each into the fullest container that still holds it; equal ones in input order."""
    places = np.empty(len(sizes), np.int64)
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: a container with r free
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            place = spaces[free].pop()
            if not spaces[free]:
                open_ ^= 1 << free
        else:
            free, place, made = capacity, made, made + 1
        free -= size
        spaces[free].append(place)
        open_ |= 1 << free
        places[i] = place
    return places


def _packed(level: int, capacity: int, names: list[str], size_at: int):
    """Packs a partition: its rows with `bin`, `load` and `done`. Only the numbers of the rows are held."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if not table:
            return
        rows = pa.Table.from_batches(table)
        sizes = rows.column(size_at).to_numpy()
        places = best_fit(sizes, capacity)
        loads = np.bincount(places, weights=sizes, minlength=1).astype(np.int64)
        task = TaskContext.get()
        base = (level << 56) | ((task.partitionId() if task else 0) << 32)
        load = loads[places]
        for name, values in (("bin", base + places), ("load", load), ("done", capacity - load <= capacity * NEARLY)):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.combine_chunks().to_batches(max_chunksize=100_000)

    return pack


def pieces(rows: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece, start, size: an item larger than `capacity` is cut into full pieces and a rest; others are one piece. A null size counts as 0."""
    whole = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    count = F.greatest(F.ceil(whole / F.lit(capacity)), F.lit(1)).cast("int")
    cut = rows.select(F.col(key).alias("key"), whole.alias("whole"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("key", "piece", start.alias("start"), F.least(F.col("whole") - start, F.lit(capacity).cast("bigint")).alias("size"))


def pack(rows: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, piece, start, size, bin: every item's pieces and their containers of `capacity`.

    Only an item larger than the capacity is cut, as in `pieces`. No container
    exceeds it; items of size 0 go into the fullest container of their partition. Any
    order of the input is right; the same input partitions give the same
    containers. The result has one row for each piece; an empty input gives none.
    Nothing is shuffled but containers that are not nearly full, of which a level
    leaves at most one at half load or less in each partition. A merging task is
    given TASK_ROWS of them; only where more are left than that at the root do they
    end in several tasks, when a round by chance joins nothing more.
    """
    items = pieces(rows, key, size, capacity)
    kind = items.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, size bigint, bin bigint, load bigint, done boolean"
    placed = stage(items.mapInArrow(_packed(0, capacity, items.columns, 3), schema), "NOT done")
    open_ = placed.df.where("NOT done").groupBy("bin").agg(F.max("load").alias("size"))
    # A container's number tells the partition that packed it; the scan's partitions are the leaves.
    branch = F.shiftright("bin", 32).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    parts = (placed.df.agg(F.max(branch)).first()[0] or 0) + 1
    waiting, level, moves = placed.held, 0, None
    while waiting > 1:
        level += 1
        least = -(-waiting // TASK_ROWS)
        fewer = max(-(-parts // FAN_IN), least)
        if fewer < parts or parts == 1:
            route = F.least(F.floor(branch / F.lit(parts / fewer)).cast("int"), F.lit(fewer - 1))
        else:  # As few as may be: containers that have not met come together by chance.
            route = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(fewer)).cast("int")
        joined = open_.select("bin", "size", route.alias("route")).repartitionById(fewer, "route").select(F.col("bin").alias("part"), "size").sortWithinPartitions("part")
        merged = stage(joined.mapInArrow(_packed(level, capacity, ["part", "size"], 1), "part bigint, size bigint, bin bigint, load bigint, done boolean"), "NOT done")
        step = merged.df.select(F.col("part"), F.col("bin").alias("next"))
        if moves is None:
            moves = step.withColumnRenamed("part", "bin")
        else:
            moves = stage(moves.alias("m").join(step.alias("s"), F.expr("m.next = s.part"), "left").select("m.bin", F.coalesce("s.next", "m.next").alias("next"))).df
        open_ = merged.df.where("NOT done").groupBy("bin").agg(F.max("load").alias("size"))
        before, waiting = merged.rows, open_.count()
        if fewer == 1 or (fewer == parts and waiting == before):
            break
        parts = fewer
    result = placed.df.select(F.col("key").alias(key), "piece", "start", "size", "bin")
    if moves is None:
        return result
    last = result.alias("r").join(moves.alias("m"), F.expr("r.bin = m.bin"), "left")
    return last.select("r." + key, "r.piece", "r.start", "r.size", F.coalesce("m.next", "r.bin").alias("bin"))
