"""Embedding near-duplicates by product quantisation.

Unit vectors go to the coarse list of their nearest centroid; the residual is coded by subspaces. A query is sent to every
list whose bisecting plane with its own list is within `margin` of it. In a list, distances come from per-query tables
over the codes (asymmetric); what the table distance less the code's own error puts within reach is reranked by exact
cosine. Centroids and codebooks are fitted on a bounded sample by hash; every vector is indexed and every vector queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.components import connected_components
from loomscan.llm.simhash import _joined
from loomscan.plans.shared import materialize

SAMPLE = 20_000
MARGIN = 0.12
BLOCK = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, centre)
        count = np.bincount(home, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centre.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    centre: np.ndarray  # lists x d
    books: list[np.ndarray]  # per subspace: codes x width
    cuts: np.ndarray  # subspace borders

    @staticmethod
    def fit(sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 64) -> Index:
        centre = _kmeans(sample, lists, 8, 1)
        rest = sample - centre[_nearest(sample, centre)]
        cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).round().astype(int)
        return Index(centre, [_kmeans(rest[:, a:b], codes, 6, 2) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of what they leave out."""
        rest = x - self.centre[home]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1)
        left = rest - np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(left, axis=1)

    def probes(self, x: np.ndarray, home: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists whose plane against the home list is within margin of the vector; the home list always."""
        length = (self.centre**2).sum(axis=1)
        d2 = length - 2 * x @ self.centre.T
        own, back = np.unique(home, return_inverse=True)
        apart = np.sqrt(np.maximum(length[own][:, None] + length - 2 * self.centre[own] @ self.centre.T, 0))[back]
        off = (d2 - d2[np.arange(len(x)), home][:, None]) / np.maximum(2 * apart, 1e-12)
        near = off <= margin
        near[np.arange(len(x)), home] = True
        return np.nonzero(near)

    def tables(self, query: np.ndarray, home: int) -> list[np.ndarray]:
        rest = query - self.centre[home]
        return [(rest[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(axis=1) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]


def _clean(single: bool):
    """Valid vectors as bytes of the values given, in single precision if they came so, with a digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raws = [], [], []
            for e in batch.column(1).to_pylist():
                v = np.array(e, float) if e and None not in e else np.zeros(0)
                largest = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
                raw = v.astype(np.float32 if single else np.float64).tobytes() if largest > 0 else None
                keys.append(None if raw is None else hashlib.md5(raw).digest())
                dims.append(None if raw is None else len(v))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "key", "dim", "unit"])

    return work


def _matrix(column, dim: int) -> np.ndarray:
    """Packed vectors as doubles of length one."""
    raws = column.to_pylist()
    if not raws:
        return np.zeros((0, dim))
    x = np.frombuffer(b"".join(raws), np.float32 if len(raws[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _send(index: Index, dim: int, margin: float, blocks: np.ndarray | None):
    """Without blocks: the home list of each vector. With the number of blocks of each list: rows for the index and for queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if blocks is None:
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(_matrix(batch.column("unit"), dim), index.centre).astype(np.int32))], names=["list"])
                continue
            first = np.r_[0, np.cumsum(blocks)]
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, ids = _matrix(part.column("unit"), dim), part.column("vec_id").to_numpy()
                home = _nearest(x, index.centre)
                row, to = index.probes(x, home, margin)
                many = blocks[to]
                row, to = np.repeat(row, many), np.repeat(first[to], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                own = first[home] + ids % blocks[home]
                cell, role, pick = np.r_[own, to], np.r_[np.zeros(len(own), np.int8), np.ones(len(to), np.int8)], pa.array(np.r_[np.arange(len(own)), row])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(role), part.column("vec_id").take(pick), part.column("copies").take(pick), part.column("unit").take(pick)], names=["cell", "role", "vec_id", "copies", "unit"])

    return work


def _search(index: Index, dim: int, blocks: np.ndarray, threshold: float, pairs: int = 1 << 20):
    """Sorted by cell and role: a cell's indexed vectors come first and stay in memory, its queries pass by in parts."""
    list_of = np.repeat(np.arange(len(blocks)), blocks)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, base, codes, error = -1, None, None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells, roles = batch.column("cell").to_numpy(), batch.column("role").to_numpy()
            cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1]), True]) if len(cells) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(int(a), int(b - a))
                if roles[a] == 0:
                    if cells[a] != cell:
                        held, cell = [], cells[a]
                    held.append(part)
                    base = None
                    continue
                if cells[a] != cell:
                    continue  # nothing is indexed in this cell
                if base is None:
                    table = pa.Table.from_batches(held)
                    base, base_id, base_n = _matrix(table.column("unit"), dim), table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
                    codes, error = index.encode(base, np.full(len(base), list_of[cell]))
                step = max(1, pairs // len(base))
                for at in range(0, part.num_rows, step):
                    query = part.slice(at, step)
                    q, q_id = _matrix(query.column("unit"), dim), query.column("vec_id").to_numpy()
                    far = np.zeros((len(q), len(base)))
                    for m, t in enumerate(index.tables(q, list_of[cell])):
                        far += t[:, codes[:, m]]
                    i, j = np.nonzero(np.sqrt(np.maximum(far, 0)) - error <= reach)
                    other = q_id[i] != base_id[j]
                    i, j = i[other], j[other]
                    if len(i) > len(q) * len(base) // 4:
                        value = (q @ base.T)[i, j]
                        near = np.flatnonzero(np.abs(value - threshold) < 1e-9)  # both ways of adding up judge these alike
                        value[near] = np.einsum("ij,ij->i", q[i[near]], base[j[near]])
                        sure = value >= threshold
                    else:
                        sure = np.einsum("ij,ij->i", q[i], base[j]) >= threshold
                    i, j = i[sure], j[sure]
                    if not len(i):
                        continue
                    links = np.bincount(i, base_n[j], len(q)).astype(np.int64)
                    names, back = np.unique(np.r_[q_id[i], base_id[j]], return_inverse=True)
                    root = names[_joined(back[: len(i)], back[len(i) :], len(names))]
                    hit = np.flatnonzero(links)
                    ids, zero = np.r_[q_id[hit], names], np.zeros(len(names), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.r_[links[hit], zero]), pa.array(np.r_[q_id[hit], root])], names=["vec_id", "links", "root"])

    return work


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, margin: float = MARGIN, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite values link with nothing; vectors of different lengths
    do not link. Equal vectors are indexed once and counted as often as they stand. Rows without an id are returned
    without links, component null, not kept. An id that stands twice counts as two vectors. Other columns are ignored.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    rows = materialize(source.mapInArrow(_clean(single), "vec_id long, key binary, dim int, unit binary"), "vectors")
    distinct = materialize(rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "distinct")
    found = []
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for dim, n in sorted((r["dim"], r["n"]) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = distinct.where(F.col("dim") == dim).select("vec_id", "copies", "unit")
        share = min(1.0, sample / n)
        some = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec_id", "unit").orderBy("vec_id").limit(2 * sample).collect()
        some = some or own.orderBy("vec_id").limit(1).collect()
        index = Index.fit(_matrix(pa.array([r["unit"] for r in some], pa.binary()), dim), int(np.clip(np.sqrt(n), 1, max(1, sample // 8))))
        size = np.zeros(len(index.centre), np.int64)
        for r in own.mapInArrow(_send(index, dim, margin, None), "list int").groupBy("list").count().collect():
            size[r["list"]] = r["count"]
        blocks = np.maximum(1, -(-size // block))
        sent = own.mapInArrow(_send(index, dim, margin, blocks), "cell int, role byte, vec_id long, copies long, unit binary")
        found.append(sent.repartition(parts, "cell").sortWithinPartitions("cell", "role").mapInArrow(_search(index, dim, blocks, threshold), "vec_id long, links long, root long"))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    hits = materialize(hits, "hits")
    links = hits.groupBy("vec_id").agg(F.sum("links").alias("links"))
    component = connected_components(hits.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "vec_id")
    judged = distinct.select("key", "vec_id", "copies").join(links, "vec_id", "left").join(component, "vec_id", "left")
    judged = judged.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(judged, "key", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
