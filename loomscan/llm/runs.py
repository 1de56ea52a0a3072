"""Streaming over sorted Arrow batches: runs of equal keys, ranges of arrays, and hashes of ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_runs(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Calls work on tables that hold whole runs of equal keys, of partitions sorted by that key.

    What a batch ends with is held back until its run ends, so no more than a batch and one run is in memory.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        if held and keys[0] == held[-1].column(key)[-1] and keys[0] == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], side="left")) if values.dtype.kind in "iu" else _run_start(values)
        done = pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
        if done.num_rows and (out := work(done)) is not None and out.num_rows:
            yield out
    if held and (out := work(pa.Table.from_batches(held))) is not None and out.num_rows:
        yield out


def _run_start(values: np.ndarray) -> int:
    at = len(values) - 1
    while at and values[at - 1] == values[-1]:
        at -= 1
    return at


def bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return start, np.r_[start[1:], len(values)]


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PowerSums:
    """Hashes of ranges of an array from sums with powers of an odd number modulo 2^64; the powers grow as far as asked for."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sums(self, names: np.ndarray) -> np.ndarray:
        self.reach(len(names))
        return np.r_[np.uint64(0), np.cumsum(names * self.up[: len(names)], dtype=np.uint64)]

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges, wherever they lie."""
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def repeated(df: DataFrame, times: str, step: int = 4096, number: str | None = None) -> DataFrame:
    """Each row as often as its column times says, which is dropped; number: a column for 0, 1, ...

    No array holds more than step items, and parts of so many are dealt anew, so that a row that stands very often is not left to one task.
    """
    part = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / step))))
    part = part.repartition("__part", *df.columns)
    one = part.withColumn("__one", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(step).cast("long"), F.col(times) - F.col("__part") * step) - 1)))
    return (one.withColumn(number, F.col("__part") * step + F.col("__one")) if number else one).drop("__part", "__one", times)
