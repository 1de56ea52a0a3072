"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest length. Pieces are dealt to shards by a hash, each shard small
enough for one task, and each shard is packed by itself, so that the cost is linear and a shard loses at most its last
bins. In a shard, pieces go in falling length into the open bin that they fill best. Where none fits, a bin is opened: each
permitted size is filled in thought with the longest pieces left, brought down to the least length that holds them, and
the size of least cost by token packed is opened. At the end each bin is downsized to its contents. The plan is held against
those that always open one size, and the least cost stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.runs import key_runs, repeated

CAPACITIES = (1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000
OVERHEAD = 8


class _Left:
    """The pieces still to come, by length."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect_left(self.sizes, n)]

    def filled(self, room: int) -> int:
        """What the longest pieces that fit, one after the other, would use of the room."""
        used, at = 0, len(self.sizes)
        while room and (at := bisect_right(self.sizes, room, 0, at)):
            n = self.sizes[at - 1]
            many = min(self.count[n], room // n)
            used, room, at = used + many * n, room - many * n, at - 1
        return used


def _packed(lengths: list[int], capacities: tuple[int, ...], overhead: int, least: int | None) -> tuple[int, list[int], list[int], list[int]]:
    """(cost, bin of each piece, offset of each piece, capacity of each bin). least: the size to open; None: the best one each time."""
    bins, offsets, used, room = [], [], [], []  # room: (free, bin), sorted
    left = _Left(lengths) if least is None else None
    for n in lengths:
        if left:
            left.take(n)
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, fits = len(used), capacities[bisect_left(capacities, n) :]
            if least is None:
                free = min(fits, key=lambda c: (_cost_by_token(n + left.filled(c - n), capacities, overhead), -c))
            else:
                free = max(least, fits[0])
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    down = [capacities[bisect_left(capacities, u)] for u in used]
    return sum(down) + overhead * len(down), bins, offsets, down


def _cost_by_token(used: int, capacities: tuple[int, ...], overhead: int) -> float:
    return (capacities[bisect_left(capacities, used)] + overhead) / used


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, capacity of each bin) of least cost: capacities plus overhead a bin.

    lengths: in falling order, none over the longest capacity. Of equal costs the plan with a size chosen for each bin
    stays, then that which opens the longer size.
    """
    if not lengths:
        return [], [], []
    plans = [_packed(lengths, capacities, overhead, least) for least in (None, *reversed(capacities))]
    return min(plans, key=lambda x: x[0])[1:]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start and length, bin_id, bin_offset, capacity, bin_used.

    Lengths are those of length_col, such as token counts; without it, bytes of the UTF-8 text, the tokens of a byte-level
    model. Null, empty and negative ones take no room and have one piece of length 0 in no bin (bin_id, offset and capacity
    null). Rows that repeat are dealt to shards one by one, like any other; null ids are packed too; other columns are
    ignored. Equal lengths are ordered by id and piece.
    """
    capacities = tuple(sorted(set(capacities)))
    longest = capacities[-1]
    size = F.greatest(F.coalesce(F.col(length_col).cast("long") if length_col else F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    # equal rows are counted and come back with a number each, so that a hash can deal them to different shards
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size")).groupBy("doc_id", "size").agg(F.count("*").alias("copies"))
    sized = repeated(counted, "copies", number="copy")
    last = F.greatest(F.floor((F.col("size") - 1) / longest), F.lit(0).cast("long"))
    pieces = sized.select("doc_id", "size", "copy", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.col("size") - F.col("piece") * longest, F.lit(longest)).alias("length"), "copy"
    )
    total = docs.select(size.alias("size")).agg(F.sum(last + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    names = ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity", "bin_used"]

    def shard_rows(table: pa.Table) -> pa.RecordBatch:
        """A whole shard, or several of them."""
        shard, n = table.column("shard").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((table.column("copy").to_numpy(), table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -n, shard))
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            full, none = own[n[own] > 0], own[n[own] == 0]
            bins, offsets, down = pack(n[full].tolist(), capacities)
            b = np.array(bins, np.int64)
            used = np.bincount(b, n[full], len(down)).astype(np.int64)
            about = table.select(names[:4])
            out.append(pa.Table.from_arrays([*about.take(pa.array(full)).columns, *(pa.array(np.asarray(x, np.int64)) for x in ((np.int64(shard[own[0]]) << 32) + b, offsets, np.array(down, np.int64)[b], used[b]))], names=names))
            out.append(pa.Table.from_arrays([*about.take(pa.array(none)).columns, *[pa.nulls(len(none), pa.int64())] * 4], names=names))
        return pa.concat_tables(out).combine_chunks().to_batches()[0]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "copy"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lambda batches: key_runs(batches, "shard", shard_rows), "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, capacity long, bin_used long")
