"""Order statistics of everything before a row, in one pass over sorted rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RunningMedian:
    """The median of what was added so far: a heap of the distinct values up to it, one of those above, and how often
    each value came. An addition takes the logarithm of the number of distinct values, and memory grows with that."""

    def __init__(self):
        self.low: list[float] = []  # negated, so that its first is the largest
        self.high: list[float] = []
        self.count: dict[float, int] = {}
        self.n = self.n_low = 0

    def add(self, value: float) -> None:
        seen = self.count.get(value, 0)
        self.count[value] = seen + 1
        to_low = bool(self.low) and value <= -self.low[0]
        if not seen:
            heapq.heappush(self.low, -value) if to_low else heapq.heappush(self.high, value)
        self.n += 1
        self.n_low += to_low
        middle = (self.n - 1) // 2  # the value of this place is the last of the low ones
        while self.n_low <= middle:
            moved = heapq.heappop(self.high)
            heapq.heappush(self.low, -moved)
            self.n_low += self.count[moved]
        while self.n_low - self.count[-self.low[0]] > middle:
            moved = -heapq.heappop(self.low)
            heapq.heappush(self.high, moved)
            self.n_low -= self.count[moved]

    def median(self) -> float | None:
        if not self.n:
            return None
        lower = -self.low[0]
        return lower if self.n // 2 < self.n_low else 0.5 * lower + 0.5 * self.high[0]


def with_expanding_median(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the median of `value` over the rows of the same key that come before; null for the first.

    Rows are dealt by key and sorted by Spark, which spills; Python then sees them in order, batch after batch, and keeps
    one group's distinct values with their counts, never a group's rows. Null and NaN values are left out; null keys are
    keys. `order` must be total for the result to be determined.
    """
    names = rows.columns
    given = rows.withColumn("_value", F.nanvl(value.cast("double"), F.lit(None).cast("double")))
    schema = rows.select("*", F.lit(0.0).alias(name)).schema
    schema[name].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, so_far = None, RunningMedian()
        for b in batches:
            out = []
            for k, v in zip(zip(*(b.column(c).to_pylist() for c in key), strict=True), b.column("_value").to_pylist(), strict=True):
                if k != group:
                    group, so_far = k, RunningMedian()
                out.append(so_far.median())
                if v is not None:
                    so_far.add(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.float64())], names=[*names, name])

    return given.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
