"""The first N rows of every group, by secondary sort and a stream over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row's group differs from the row's before; the first row starts a group. Nulls are equal."""
    changed = np.zeros(table.num_rows, bool)
    for k in keys:
        here, before = table.column(k).slice(1), table.column(k).slice(0, table.num_rows - 1)
        valid, valid_before = pc.is_valid(here).to_numpy(), pc.is_valid(before).to_numpy()
        changed[1:] |= pc.fill_null(pc.not_equal(here, before), False).to_numpy() | (valid != valid_before)
    changed[:1] = True
    return changed


def _streamed(keys: Sequence[str], n: int, over: int, schema: pa.Schema | None = None):
    """Emits the first `n` rows of each group that has more than `over` rows; what is carried between batches is the head of one group, at most max(n, over + 1) rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def picked(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(np.append(starts, table.num_rows))
            rank = np.arange(table.num_rows) - np.repeat(starts, sizes)
            kept = table.filter(pa.array((rank < n) & np.repeat(sizes > over, sizes)))
            yield from kept.combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            if not table.num_rows:
                continue
            starts = np.flatnonzero(_changes(table, keys))
            last = int(starts[-1])
            if last:
                yield from picked(table.slice(0, last), starts[:-1])
            carry = table.slice(last, max(n, over + 1)).combine_chunks()
        if carry is not None and carry.num_rows:
            yield from picked(carry, np.zeros(1, np.int64))

    return stream


def top_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, over: int = 0) -> DataFrame:
    """The first `n` rows of each group of `keys` in `order`, of the groups with more than `over` rows.

    `order` should end in an identifier, so that ties always fall the same way. A
    null key is a key like any other. Each task first sorts and streams the rows it
    has and sends on only the head of each group (max(n, over + 1) rows), so that a
    group of any size reaches its one task as a few rows from each of the others;
    then the heads are hash-partitioned by group, sorted and streamed again. No
    group is buffered.
    """
    head = max(n, over + 1)
    keys, by = list(keys), [F.col(k) for k in keys]
    local = rows.sortWithinPartitions(*by, *order).mapInArrow(_streamed(keys, head, 0), rows.schema)
    routed = local.repartition(*by).sortWithinPartitions(*by, *order)
    return routed.mapInArrow(_streamed(keys, n, over), rows.schema)
