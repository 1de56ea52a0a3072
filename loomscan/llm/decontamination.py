"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds, hashes of `seed` consecutive words. Seeds on one diagonal make maximal
matches; the longest match whose words are unmarked on both sides is marked as a tile, again and again, until no match of
a seed's length is left. The share of an item's words that tiles cover is found wherever and in whatever order its
passages stand in the document.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.llm.runs import PowerSums

SEED = 5
COVERAGE = 0.8
BROADCAST_ITEMS = 20_000
BROADCAST_BYTES = 32 << 20
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 18


def words_of(text: str | None) -> np.ndarray:
    """64-bit names of the lower-cased words."""
    digest = xxhash.xxh3_64_intdigest
    words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").lower())]
    return np.fromiter(map(digest, words), np.uint64, len(words))


def seeds_of(names: np.ndarray, seed: int) -> np.ndarray:
    """Rolling hashes of all runs of seed words."""
    n = len(names) - seed + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(seed):
        out = out * _STEP + names[i : i + n]
    return out ^ (out >> np.uint64(31))


def tiles(doc: np.ndarray, item: np.ndarray, seed: int, limit: int = 1 << 16) -> list[tuple[int, int, int]]:
    """(document word, item word, length) of the tiles of a greedy string tiling with tiles of at least seed words.

    The longest match of unmarked words comes first, of equal ones that of the least document word, then item word. Up to
    limit pairs of equal seeds are put together to matches; texts that repeat themselves more are searched length by length.
    """
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return []
    own, wanted = seeds_of(doc, seed), seeds_of(item, seed)
    names, back, count = np.unique(wanted, return_inverse=True, return_counts=True)
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    hit = np.flatnonzero(names[at] == own)
    if count[at[hit]].sum() > limit:
        return _tiles_by_length(doc, item, seed)
    places: dict[int, list[int]] = {}
    for j, k in enumerate(back.tolist()):
        places.setdefault(k, []).append(j)
    pairs = sorted((j - i, i) for i, k in zip(hit.tolist(), at[hit].tolist(), strict=True) for j in places[k])
    heap, k = [], 0
    while k < len(pairs):
        end = k
        while end + 1 < len(pairs) and pairs[end + 1] == (pairs[k][0], pairs[end][1] + 1):
            end += 1
        heap.append((-(end - k + seed), pairs[k][1], pairs[k][1] + pairs[k][0]))
        k = end + 1
    heapq.heapify(heap)
    doc_free, item_free, out, left = np.ones(len(doc), bool), np.ones(len(item), bool), [], len(item)
    while heap and left:
        size, i, j = heapq.heappop(heap)
        size = -size
        free = doc_free[i : i + size] & item_free[j : j + size]
        if free.all():
            doc_free[i : i + size] = item_free[j : j + size] = False
            out.append((i, j, size))
            left -= size
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= seed:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def _tiles_by_length(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same tiling by running hashes: the greatest length with a common unmarked run is found by halving, and its first match is marked."""
    powers = PowerSums()
    doc_sums, item_sums = powers.sums(doc), powers.sums(item)
    doc_free, item_free, out = np.ones(len(doc), bool), np.ones(len(item), bool), []

    def free_runs(free: np.ndarray, size: int) -> np.ndarray:
        taken = np.r_[0, np.cumsum(~free)]
        return np.flatnonzero(taken[size:] == taken[:-size])

    def first(size: int) -> tuple[int, int] | None:
        i, j = free_runs(doc_free, size), free_runs(item_free, size)
        if not (len(i) and len(j)):
            return None
        a, b = powers.of(doc_sums, i, i + size), powers.of(item_sums, j, j + size)
        met = np.flatnonzero(np.isin(a, b))
        return (int(i[met[0]]), int(j[np.flatnonzero(b == a[met[0]])[0]])) if len(met) else None

    most = min(len(item), len(doc))
    while most >= seed:
        low, high, best = seed - 1, most, None
        while low < high:
            size = (low + high + 1) // 2
            if (found := first(size)) is not None:
                low, best = size, found
            else:
                high = size - 1
        if best is None:
            break
        i, j = best
        doc_free[i : i + low] = item_free[j : j + low] = False
        out.append((i, j, low))
        most = low
    return out


class Items:
    """A benchmark in memory: seeds to items."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        self.ids = [i for i, _ in rows]
        self.names = [words_of(t) for _, t in rows]
        self.by_size: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, names in enumerate(self.names):
            size = min(seed, len(names))
            for j, s in enumerate(seeds_of(names, size).tolist() if size else ()):
                found.setdefault(size, {}).setdefault(s, []).append((k, j))
        for size, seeds in found.items():
            order = sorted(seeds)
            self.by_size[size] = np.array(order, np.uint64), [np.array(seeds[s], np.int64) for s in order]

    def matches(self, names: np.ndarray, first: np.ndarray, seed: int, coverage: float) -> Iterator[tuple[int, int, float, int]]:
        """(document, item, coverage, tiles) at or above coverage, of documents laid end to end."""
        bound: dict[tuple[int, int], set[int]] = {}
        for size, (order, places) in self.by_size.items():
            own = seeds_of(names, size)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(order, own), len(order) - 1)
            hit = np.flatnonzero(order[at] == own)
            doc = np.searchsorted(first, hit, side="right") - 1
            inside = hit + size <= first[doc + 1]
            pairs = np.unique(np.c_[doc[inside], at[hit[inside]]], axis=0)
            for d, a in pairs.tolist():
                for k, j in places[a].tolist():
                    bound.setdefault((d, k), set()).update(range(j, j + size))
        for (d, k), covered in bound.items():
            item = self.names[k]
            if len(covered) < coverage * len(item):
                continue
            found = tiles(names[first[d] : first[d + 1]], item, seed)
            share = sum(n for _, _, n in found) / len(item)
            if share >= coverage:
                yield d, k, share, len(found)


_FOUND = "item_id long, coverage double, n_tiles int"


def _in_parts(texts: list, known: Items, seed: int, coverage: float) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, coverage, tiles), so many words at a time."""
    got, names, many = [], [], 0
    for i in range(len(texts) + 1):
        if got and (i == len(texts) or many >= _PART):
            first = np.r_[0, np.cumsum([len(x) for x in names])]
            for d, k, share, n in known.matches(np.concatenate(names), first, seed, coverage):
                yield got[d], known.ids[k], share, n
            got, names, many = [], [], 0
        if i < len(texts):
            got.append(i)
            names.append(words_of(texts[i]))
            many += len(names[-1])


def _held(benchmark: DataFrame, broadcast_items: int) -> tuple[DataFrame, list | None]:
    """(items, their rows if they are few enough for every task)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null")
    size = items.limit(broadcast_items + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("b")).first()
    small = size["n"] <= broadcast_items and size["b"] <= BROADCAST_BYTES
    return items, sorted((r["item_id"], r["item"]) for r in items.collect()) if small else None


def _found_in(text: Column, rows: list, seed: int, coverage: float, spark) -> Column:
    """For each text the items it holds: an array of (item_id, coverage, n_tiles). The items go to every task once."""
    sent = spark.sparkContext.broadcast(rows)

    @F.pandas_udf("array<struct<item_id:long,coverage:double,n_tiles:int>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Items(sent.value, seed)
        for texts in parts:
            out: list[list] = [[] for _ in range(len(texts))]
            for i, item, share, n in _in_parts(texts.tolist(), known, seed, coverage):
                out[i].append({"item_id": item, "coverage": share, "n_tiles": n})
            yield pd.Series(out, dtype=object)

    return found(text)


def text_key(text: Column) -> Column:
    """A 128-bit name of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE, broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles): documents that hold at least the share coverage of an item's words in tiles.

    Words are lower-cased runs of letters, digits and underscores; items of fewer than seed words must match whole.
    Null and empty texts match nothing. Rows without an id are left out on either side; repeated rows give their pairs
    once. A benchmark of at most broadcast_items items and 32 MiB goes to every task; a larger one is joined by seeds.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items, rows = _held(benchmark, broadcast_items)
    if rows is not None:
        found = source.select("doc_id", _found_in(F.col("text"), rows, seed, coverage, docs.sparkSession).alias("x"))
        return found.select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.*").distinct()
    pairs = _joined_by_seeds(source.select("text"), items, seed, coverage)
    return source.select("doc_id", text_key(F.col("text")).alias("key")).join(pairs, "key").select("doc_id", "item_id", "coverage", "n_tiles").distinct()


def _joined_by_seeds(texts: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """(key, item_id, coverage, n_tiles) of distinct texts, by their key. Copies of a text are one row from the first shuffle on."""
    schema = f"key struct<a:bigint,b:bigint>, {_FOUND}"

    def item_seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = words_of(t)
                if not len(names):
                    continue
                k = min(seed, len(names))
                found, times = np.unique(seeds_of(names, k) + np.uint64(k), return_counts=True)
                needed = coverage * len(names) / k - 1e-9
                many = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, i, np.int64)), pa.array(found.view(np.int64)), pa.array(times, pa.int64()), pa.array(np.full(many, needed)), pa.array(np.full(many, k, np.int32))], names=["item_id", "seed", "times", "needed", "size"])

    item_seeds = items.mapInArrow(item_seed_rows, "item_id long, seed long, times long, needed double, size int")
    sizes = sorted(r["size"] for r in item_seeds.select("size").distinct().collect())  # at most seed of them
    wanted = _bits(item_seeds)

    def doc_seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for row, t in enumerate(batch.column("text").to_pylist()):
                names = words_of(t)
                found = np.unique(np.concatenate([np.zeros(0, np.uint64), *[seeds_of(names, k) + np.uint64(k) for k in sizes]]))
                found = found[_known(bits, found)]
                if len(found):
                    key = batch.column("key").slice(row, 1).take(pa.array(np.zeros(len(found), np.int64)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(found.view(np.int64))], names=["key", "seed"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                item = words_of(r["item"])
                found = tiles(words_of(r["text"]), item, seed)
                share = sum(n for _, _, n in found) / max(1, len(item))
                if share >= coverage:
                    out.append({"key": r["key"], "item_id": r["item_id"], "coverage": share, "n_tiles": len(found)})
            if out:
                kinds = pa.struct([("key", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32())])
                yield pa.RecordBatch.from_struct_array(pa.array(out, kinds))

    keyed = texts.where("text is not null").select(text_key(F.col("text")).alias("key"), "text")
    doc_seeds = keyed.mapInArrow(doc_seed_rows, "key struct<a:bigint,b:bigint>, seed long").distinct()
    # every tile of t words holds t - seed + 1 seeds, one at each place of the item where it begins, so covering c words of an item takes
    # at least c / seed places; a seed the document holds may be a tile's at each place where the item repeats it
    pairs = doc_seeds.join(item_seeds.drop("size"), "seed").groupBy("key", "item_id").agg(F.sum("times").alias("places"), F.min("needed").alias("needed"))
    likely = pairs.where(F.col("places") >= F.col("needed")).select("key", "item_id")
    one = keyed.join(likely.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    return likely.join(one, "key").join(items, "item_id").select("key", "item_id", "text", "item").mapInArrow(judge, schema).distinct()


BIT_WORDS = 1 << 20


def _bits(seeds: DataFrame):
    """Which of 2^26 slots the seeds fall in, as 2^20 words of 64 bits: 8 MiB for every task, however many seeds there are."""
    slots = seeds.select(F.shiftrightunsigned("seed", 38).cast("int").alias("slot"))
    words = slots.selectExpr("slot >> 6 as w", "1L << (slot & 63) as m").groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(BIT_WORDS, np.int64)
    for r in words.toLocalIterator():  # at most 2^20 rows
        out[r["w"]] = r["m"]
    return seeds.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _known(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    slot = seeds >> np.uint64(38)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns as they are. Each row is judged by its own text, with or without an id."""
    items, rows = _held(benchmark, broadcast_items)
    text = F.col("text").cast("string")
    if rows is not None:
        return docs.where(F.size(_found_in(text, rows, seed, coverage, docs.sparkSession)) == 0)
    doomed = _joined_by_seeds(docs.select(text.alias("text")), items, seed, coverage).select(F.col("key").alias("__drop")).distinct()
    return docs.join(doomed, text_key(docs["text"].cast("string")) == F.col("__drop"), "left_anti")
