"""Occurrences and distinct records of every n-gram, by sorted suffixes.

Every position of a sequence gives the suffix that starts there, cut off at
`sigma` symbols. Suffixes are routed by their first symbol and sorted in reverse
lexicographic order, so that those that share a prefix stand together and a
longer one comes before its own prefixes. One pass with a stack of at most
`sigma` entries then counts all prefixes: an entry that the next suffix no longer
continues is complete, and its count and records go to the entry below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A first symbol's suffixes go to this many buckets by record, so that a symbol that stands in every row is many tasks' work. Record counts add up over them, since a record is in one bucket.
RECORD_BUCKETS = 256


class _Stack:
    """The open prefixes, longest last: for each its occurrences and the records seen, as arrays of numbers."""

    def __init__(self, sigma: int):
        self.sigma = sigma
        self.symbols: list[str | None] = [None] * sigma
        self.held = 0
        self.counts = [0] * sigma
        self.records: list[list[np.ndarray]] = [[] for _ in range(sigma)]


def _counter(sigma: int):
    names = [f"s{i}" for i in range(sigma)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, numbers = _Stack(sigma), {}

        def closed(depth: int, out: list) -> None:
            """Pop the entries deeper than `depth`, handing their counts and records down."""
            while stack.held > depth:
                k = stack.held - 1
                records = np.unique(np.concatenate(stack.records[k]))
                out.append((stack.symbols[: k + 1], stack.counts[k], len(records)))
                if k:
                    stack.counts[k - 1] += stack.counts[k]
                    stack.records[k - 1].append(records)
                    if len(stack.records[k - 1]) > 64:
                        stack.records[k - 1] = [np.unique(np.concatenate(stack.records[k - 1]))]
                stack.counts[k], stack.records[k], stack.symbols[k] = 0, [], None
                stack.held -= 1

        def emitted(out: list) -> pa.RecordBatch:
            columns = [pa.array([row[0][i] if i < len(row[0]) else None for row in out], pa.string()) for i in range(sigma)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=[*names, "occurrences", "records"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if stack.held and batch.column("s0")[0].as_py() != stack.symbols[0]:
                numbers.clear()  # no open entry has records: numbers last for one first symbol and a batch
                done: list = []
                closed(0, done)
                yield emitted(done)
            coded = batch.column("record").dictionary_encode()
            local = np.fromiter((numbers.setdefault(r, len(numbers)) for r in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            record = local[coded.indices.to_numpy(zero_copy_only=False)]
            symbols = [batch.column(n) for n in names]
            length = np.zeros(batch.num_rows, np.int64)
            fresh = np.zeros(batch.num_rows, bool)  # the suffix differs from the one before, within the batch
            common = np.full(batch.num_rows, sigma, np.int64)  # symbols it shares with the one before
            for i, column in enumerate(symbols):
                length += column.is_valid().to_numpy(zero_copy_only=False)
                differs = np.zeros(batch.num_rows, bool)
                here, before = column.slice(1), column.slice(0, batch.num_rows - 1)
                unequal = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
                differs[1:] = unequal | (here.is_valid().to_numpy(zero_copy_only=False) != before.is_valid().to_numpy(zero_copy_only=False))
                common[differs & ~fresh] = i
                fresh |= differs
            fresh[0] = True
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], batch.num_rows)
            rows = batch.select(names).take(pa.array(starts)).to_pydict()
            lists, out = [rows[n] for n in names], []
            for j, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                size = int(length[a])
                if j:
                    shared = min(int(common[a]), size)
                else:
                    shared = 0
                    while shared < min(size, stack.held) and stack.symbols[shared] == lists[shared][0]:
                        shared += 1
                closed(shared, out)
                for k in range(stack.held, size):
                    stack.symbols[k] = lists[k][j]
                stack.held = size
                stack.counts[size - 1] += b - a
                stack.records[size - 1].append(record[a:b])
            if out:
                yield emitted(out)
        out = []
        closed(0, out)
        if out:
            yield emitted(out)

    return count


def suffixes(rows: DataFrame, sequence: str, record: str, sigma: int) -> DataFrame:
    """s0..s(sigma-1), record: the suffix at every position, cut off at `sigma` symbols and padded with nulls."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(sequence)), lambda i: F.slice(sequence, i, sigma)))
    held = rows.where(F.size(sequence) > 0).select(F.col(record).alias("record"), F.col(sequence)).select("record", at.alias("position", "suffix"))
    return held.select(*(F.get("suffix", F.lit(i)).alias(f"s{i}") for i in range(sigma)), "record")


def ngram_counts(rows: DataFrame, sequence: str, record: str, sigma: int = 2) -> DataFrame:
    """s0..s(sigma-1), occurrences, records: every n-gram of 1 to `sigma` symbols of the arrays in `sequence`.

    Shorter n-grams are padded with nulls. `occurrences` counts positions, `records`
    the distinct values of `record` (text) in which the n-gram stands. Null symbols
    are left out of their sequence first; null and empty sequences have no n-grams,
    and a null record is one record of its own. Other columns of `rows` are ignored.
    """
    shaped = rows.select(F.coalesce(F.col(record).cast("string"), F.lit("")).alias("record"), F.filter(sequence, lambda x: x.isNotNull()).alias("sequence"))
    cut = suffixes(shaped, "sequence", "record", sigma)
    names = [f"s{i}" for i in range(sigma)]
    routed = cut.withColumn("__bucket", F.pmod(F.xxhash64("record"), F.lit(RECORD_BUCKETS))).repartition("s0", "__bucket")
    ordered = routed.sortWithinPartitions(*(F.col(n).desc_nulls_last() for n in names)).select(*names, "record")
    schema = ", ".join(f"{n} string" for n in names) + ", occurrences bigint, records bigint"
    parts = ordered.mapInArrow(_counter(sigma), schema)
    return parts.groupBy(*names).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: DataFrame, rare: int = 1, common: int = 20) -> DataFrame:
    """`counts` with `mark`: 'rare' in at most `rare` records, 'common' in at least one in `common` of all (`total`, one row and column), else null."""
    (name,) = total.columns
    both = counts.join(F.broadcast(total.withColumnRenamed(name, "__total")), F.lit(True))  # one row
    mark = F.when(F.col("records") <= rare, F.lit("rare")).when(F.col("records") * common >= F.col("__total"), F.lit("common"))
    return both.withColumn("mark", mark).drop("__total")
