"""Ranked lexical search with prefix trees of documents.

Items are answered in blocks of bounded size. For a block, one pass over the texts keeps of each document its length and the
counts of the block's terms; corpus statistics are aggregated from these rows. A second pass gathers the rows of a task into
prefix trees: a document's terms, commonest in the corpus first, are its path, so that documents share beginnings; chains
without a fork are one node. A node knows the largest count of each term and the least length weight below it, which bounds
every item's score there. Each item descends depth first, best bound first, and leaves out what can't enter its best k so
far; all items still interested in a node share its numbers. Tasks give their best k, which are ranked together.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomscan.plans.shared import materialize

K = 10
BLOCK_ITEMS, BLOCK_CHARS = 256, 1 << 20
TREE_TERMS = 400_000
BUCKET = 24
_CUT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_EXACT = 1 << 53


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_CUT).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Items with their terms numbered. weights and order (commonest first) follow from the corpus."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        counts = [Counter(terms(t)) for _, t in items]
        self.number = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        self.counts = [(np.array([self.number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        size = len(self.number)
        self.weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(size)], np.int64)
        self.rank = np.empty(size, np.int64)
        self.rank[sorted(range(size), key=lambda t: (-df.get(t, 0), t))] = np.arange(size)

    def matrix(self) -> np.ndarray:
        """Terms by rank against items: how often an item has the term. Floats where every score stays an exact integer in them."""
        longest = max((int(n.sum()) for _, n in self.counts), default=0)
        kind = np.float64 if longest * max(1, int(self.weights.max(initial=0))) * 1_000_000 < _EXACT else np.int64
        out = np.zeros((len(self.number), len(self.ids)), kind)
        for i, (t, n) in enumerate(self.counts):
            out[self.rank[t], i] = n
        return out

    def ranked_weights(self) -> np.ndarray:
        out = np.zeros(len(self.number), np.int64)
        out[self.rank] = self.weights
        return out


class Node:
    """The documents lo..hi of a tree: least id, least m, the terms below with their largest counts, and the children; a leaf has none."""

    __slots__ = ("children", "hi", "least_id", "least_m", "lo", "most", "terms")

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.children = lo, hi, []


class Tree:
    """A prefix tree of documents, each a path of ranks in ascending order with counts. Documents without an id sort after all others."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, m: np.ndarray, paths: list[np.ndarray], counts: list[np.ndarray], bucket: int = BUCKET):
        order = sorted(range(len(paths)), key=[(p.astype(">u4").tobytes(), bool(z), i) for p, z, i in zip(paths, no_id, ids.tolist(), strict=True)].__getitem__)
        self.ids, self.no_id, self.m = ids[order], no_id[order], m[order]
        self.sizes = np.array([len(paths[k]) for k in order], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate([paths[k] for k in order]) if order else np.zeros(0, np.int64)
        self.tf = np.concatenate([counts[k] for k in order]) if order else np.zeros(0, np.int64)
        self.bucket = bucket
        self.root = self._grow() if order else None

    def _at(self, lo: int, hi: int, depth: int) -> np.ndarray:
        """The terms of documents lo..hi at a depth, -1 where the path has ended."""
        out = np.full(hi - lo, -1, np.int64)
        there = self.sizes[lo:hi] > depth
        out[there] = self.flat[self.start[lo:hi][there] + depth]
        return out

    def _fork(self, lo: int, hi: int, depth: int) -> int:
        """How many terms the paths of lo..hi share: those that the first and the last of them do."""
        a, b = self.flat[self.start[lo] + depth : self.start[lo + 1]], self.flat[self.start[hi - 1] + depth : self.start[hi]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return depth + (int(differ[0]) if len(differ) else n)

    def _grow(self) -> Node:
        root = Node(0, len(self.sizes))
        made, open_nodes = [], [(root, 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            made.append(node)
            lo, hi = node.lo, node.hi
            if hi - lo > self.bucket:
                depth = self._fork(lo, hi, depth)
                at = self._at(lo, hi, depth)
                cuts = [lo, *(np.flatnonzero(np.diff(at)) + 1 + lo).tolist(), hi]
                if len(cuts) > 2:
                    node.children = [Node(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
                    open_nodes += [(c, depth) for c in node.children]
        for node in reversed(made):
            self._bound(node)
        return root

    def _bound(self, node: Node) -> None:
        if node.children:
            t, n = np.concatenate([c.terms for c in node.children]), np.concatenate([c.most for c in node.children])
            node.least_m, node.least_id = min(c.least_m for c in node.children), min(c.least_id for c in node.children)
        else:
            lo, hi = self.start[node.lo], self.start[node.hi]
            t, n = self.flat[lo:hi], self.tf[lo:hi]
            node.least_m, node.least_id = int(self.m[node.lo : node.hi].min()), min(zip(self.no_id[node.lo : node.hi].tolist(), self.ids[node.lo : node.hi].tolist(), strict=True))
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        node.terms, node.most = t[first], np.maximum.reduceat(n, first) if len(first) else n


def share(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The best k (score, document) of each item. Heaps hold (score, no id, id) with the worst first."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.score, self.no_id, self.id = np.zeros(items, np.int64), np.ones(items, bool), np.full(items, np.iinfo(np.int64).max)

    def may_enter(self, items: np.ndarray, scores: np.ndarray, no_id, ids) -> np.ndarray:
        """Whether documents of these scores and ids would be among the best k of the items."""
        s, z, i = self.score[items], self.no_id[items], self.id[items]
        before = (no_id < z) | ((no_id == z) & (ids < i))
        return (scores > 0) & ((scores > s) | ((scores == s) & before))

    def add(self, item: int, score: int, no_id: bool, doc: int) -> None:
        heap, entry = self.heaps[item], (score, -no_id, -doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.score[item], self.no_id[item], self.id[item] = heap[0][0], bool(-heap[0][1]), -heap[0][2]


def search(tree: Tree, matrix: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Descends from the root for all items; returns how many documents were scored for an item."""
    scored = 0

    def bounds(node: Node, items: np.ndarray) -> np.ndarray:
        c = (weights[node.terms] * share(node.most, node.least_m)).astype(matrix.dtype)
        return (c @ matrix[node.terms][:, items]).astype(np.int64)

    if tree.root is None:
        return 0
    every = np.arange(matrix.shape[1])
    stack = [(tree.root, every, bounds(tree.root, every))]
    while stack:
        node, items, bound = stack.pop()
        alive = best.may_enter(items, bound, *node.least_id)
        items = items[alive]
        if not len(items):
            continue
        if node.children:
            below = [(c, items, bounds(c, items)) for c in node.children]
            below.sort(key=lambda x: int(x[2].max()))
            stack += below
            continue
        lo, hi = node.lo, node.hi
        scored += (hi - lo) * len(items)
        at = np.searchsorted(node.terms, tree.flat[tree.start[lo] : tree.start[hi]])
        dense = np.zeros((hi - lo, len(node.terms)), np.int64)
        dense[np.repeat(np.arange(hi - lo), tree.sizes[lo:hi]), at] = tree.tf[tree.start[lo] : tree.start[hi]]
        c = (weights[node.terms] * share(dense, tree.m[lo:hi, None])).astype(matrix.dtype)
        scores = (c @ matrix[node.terms][:, items]).astype(np.int64)
        ids, no_id = tree.ids[lo:hi], tree.no_id[lo:hi]
        enter = best.may_enter(items[None, :], scores, no_id[:, None], ids[:, None])
        for j in np.flatnonzero(enter.any(axis=0)):
            rows = np.flatnonzero(enter[:, j])
            if len(rows) > best.k:
                rows = rows[np.lexsort((ids[rows], no_id[rows], -scores[rows, j]))[: best.k]]
            for r in rows.tolist():
                best.add(int(items[j]), int(scores[r, j]), bool(no_id[r]), int(ids[r]))
    return scored


def _blocks(items: DataFrame, most_items: int, most_chars: int) -> Iterator[Block]:
    """Blocks of items; an item longer than most_chars is a block of its own. The driver holds one block."""
    held, chars = [], 0
    for r in items.toLocalIterator():
        size = len(r["text"] or "")
        if held and (len(held) >= most_items or chars + size > most_chars):
            yield Block(held)
            held, chars = [], 0
        held.append((r["item_id"], r["text"]))
        chars += size
    if held:
        yield Block(held)


def _vectors(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, term, tf) of each document: its length and its counts of the block's terms."""
    number = block.number

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, counts = [], [], []
            for text in batch.column("text"):
                words = terms(text.as_py())
                own = {number[w]: k for w, k in Counter(words).items() if w in number}
                n.append(len(words))
                found.append(list(own))
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(restrict, "doc_id long, n long, term array<int>, tf array<int>")


def _answers(vectors: DataFrame, block: Block, n_docs: int, n_terms: int, k: int, tree_terms: int) -> DataFrame:
    """(item, doc_id, score): the best k of each task."""
    rank, weights = block.rank, block.ranked_weights()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best = block.matrix(), Best(len(block.ids), k)
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            ids, m, paths, counts = zip(*held, strict=True)
            tree = Tree(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array(m, np.int64), list(paths), list(counts))
            search(tree, matrix, weights, best)

        for batch in batches:
            ids, n = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            lists, tfs = batch.column("term"), batch.column("tf")
            offsets = lists.offsets.to_numpy()
            path, tf = rank[lists.values.to_numpy()], tfs.values.to_numpy().astype(np.int64)
            for i, doc in enumerate(ids):
                a, b = offsets[i], offsets[i + 1]
                if a < b:
                    order = np.argsort(path[a:b])
                    held.append((doc, 25 + 75 * n[i] * n_docs // n_terms, path[a:b][order], tf[a:b][order]))
                    size += int(b - a)
                    if size >= tree_terms:
                        flush()
                        held, size = [], 0
        if held:
            flush()
        rows = [(i, None if z else -d, s) for i, heap in enumerate(best.heaps) for s, z, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return vectors.where("size(term) > 0").mapInArrow(answer, "item int, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, tree_terms: int = TREE_TERMS) -> DataFrame:
    """For each row of items its k best documents with score above 0: item_id, rank, doc_id, score.

    Equal scores go by doc_id, documents without an id last; rows of one id are ranked each. Null and empty texts have no terms: such documents are never
    found and such items find nothing. Repeated items are answered each. No documents or no items give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, block_items, block_chars):
        vectors = materialize(_vectors(docs, block), "vectors")
        n_docs, n_terms = vectors.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not block.number:
            continue
        df = dict(vectors.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect())  # one row a term of the block
        block.weigh(n_docs, df)
        found = _answers(vectors, block, n_docs, n_terms, k, tree_terms)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long"))  # block_items rows at most
        out = out.unionByName(materialize(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out
