"""Removal of long repeats by recompression.

Words get 64-bit names; one round names runs of equal words, further rounds name pairs of a left and a right symbol,
the side being a bit of the symbol's name. Names are hashes of what they stand for: equal runs and pairs get equal names in
every task, which is what a naming round over all documents would give, without shuffling every symbol in every round.
A symbol depends on its context only, a range of words that every round tracks; two equal windows therefore hold the
same symbols wherever a symbol's context lies inside the window. Each window is anchored at the least named such
symbol of the highest level that has one (words in the worst case), and neighbouring windows of one anchor form a block. Spark
finds anchors that several documents share, then blocks of equal content, and verifies what is left window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.runs import PowerSums, mixed, ramp
from loomscan.plans.shared import materialize

ROUNDS = 6
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORDS = 1 << 18


def levels(names: np.ndarray, first: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, context start, context end) of the symbols of each level, words first. first: start of each document, and the end."""
    n = len(names)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(n)
    yield mixed(names), start, start + 1
    head = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])])
    end = np.r_[head[1:], n]
    length = (end - head).astype(_U)
    name = np.where(length > 1, mixed(names[head] * _U(_BASES[1]) + length), names[head])
    doc, cs, ce = doc[head], head - 1, end + 1
    for level in range(rounds):
        if len(name) < 2:
            break
        left = (mixed(name + _U(level * 2 + 1)) & _U(1)) == 0
        same = doc[1:] == doc[:-1]
        pair = np.r_[left[:-1] & ~left[1:] & same, False]
        second = np.r_[False, pair[:-1]]
        after = np.r_[np.where(same, ce[1:], first[doc[:-1] + 1] + 1), first[doc[-1] + 1] + 1]
        before = np.r_[first[doc[0]] - 1, np.where(same, cs[:-1], first[doc[1:]] - 1)]
        ce = np.where(left, np.maximum(ce, after), ce)  # a pair ends with its second, an unpaired left one looks at the next
        cs = np.where(left, cs, np.minimum(cs, before))
        at = np.flatnonzero(pair)
        name = name.copy()
        name[at] = mixed(name[at] * _U(_BASES[0]) + mixed(name[at + 1]) + _U(level))
        keep = ~second
        name, doc, cs, ce = name[keep], doc[keep], cs[keep], ce[keep]
        yield name, cs, ce


def _least(values: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least value, the leftmost of equals, of each range."""
    depth = np.frexp((last - start + 1).astype(np.float64))[1] - 1
    out, table = np.zeros(len(start), np.int64), np.arange(len(values))
    for d in range(int(depth.max()) + 1 if len(depth) else 0):
        at = np.flatnonzero(depth == d)
        a, b = table[start[at]], table[last[at] - (1 << d) + 1]
        out[at] = np.where(values[a] <= values[b], a, b)
        a, b = table[: -(1 << d)], table[1 << d :]
        table = np.where(values[a] <= values[b], a, b)
    return out


def blocks(names: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS, powers: PowerSums | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last window start) of all blocks; every window of every document is in one block.

    An anchor is the content of the chosen symbol's context, which lies in the window and says more than the symbol alone.
    """
    powers = powers or PowerSums(_BASES[0])
    sums = powers.sums(names)
    count = np.maximum(np.diff(first) - window + 1, 0)
    p = np.repeat(first[:-1], count) + ramp(count)
    anchor, place = np.zeros(len(p), _U), np.zeros(len(p), np.int64)
    open_ = np.arange(len(p))
    for depth, (name, cs, ce) in enumerate(reversed(list(levels(names, first, rounds)))):
        if not len(open_):
            break
        q = p[open_]
        k, last = np.searchsorted(cs, q), np.searchsorted(ce, q + window, side="right") - 1
        ok = k <= last
        at, k = open_[ok], _least(mixed(name), k[ok], last[ok])
        anchor[at], place[at] = powers.of(sums, cs[k], ce[k]), k * (rounds + 3) + depth
        open_ = open_[~ok]
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)]) if len(p) else np.zeros(0, np.int64)
    return anchor[cut], p[cut], p[np.r_[cut[1:], len(p)] - 1] if len(p) else p


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _named(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), _U, len(words))


def _pieces(ids: list, keys: list, texts: list, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, text keys, document starts, names) of some documents at a time; those too short for a window are left out."""
    got, names, size = [], [], 0

    def piece():
        return np.array([i for i, _ in got], np.int64), np.array([k for _, k in got], np.int64), np.r_[0, np.cumsum([len(x) for x in names])], np.concatenate(names)

    for i, k, t in zip(ids, keys, texts, strict=True):
        if i is None or len(words := _words(t)) < window:
            continue
        got.append((i, k))
        names.append(_named(words))
        size += len(words)
        if size >= _WORDS:
            yield piece()
            got, names, size = [], [], 0
    if got:
        yield piece()


def _anchor_rows(window: int, rounds: int, with_blocks: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = PowerSums(_BASES[0])
        for batch in batches:
            for ids, keys, first, names in _pieces(*(batch.column(k).to_pylist() for k in ("doc_id", "key", "text")), window):
                anchor, lo, hi = blocks(names, first, window, rounds, powers)
                doc = np.searchsorted(first, lo, side="right") - 1
                if with_blocks:
                    content = powers.of(powers.sums(names), lo, hi + window)
                    order = np.lexsort((lo, content, anchor, doc))  # equal blocks of a document make one row
                    a, c, d = anchor[order], content[order], doc[order]
                    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]) if len(order) else order
                    places = pa.ListArray.from_arrays(pa.array(np.r_[new, len(order)].astype(np.int32)), pa.array((lo - first[doc])[order].astype(np.int32)))
                    cols = [a[new].view(np.int64), ids[d[new]], keys[d[new]], (hi - lo)[order][new].astype(np.int32), c[new].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), places], names=["name", "doc_id", "key", "width", "block", "lo"])
                else:
                    order = np.lexsort((anchor, doc))
                    a, d = anchor[order], doc[order]
                    new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(ids[d[new]])], names=["name", "doc_id"])

    return work


def _window_rows(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, unzip = [PowerSums(b) for b in _BASES], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, key, z, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "key", "packed", "spans")), strict=True):
                names = _named(unzip(z).split())
                lo, hi = (np.array([s[k] for s in spans], np.int64) for k in ("lo", "hi"))
                hi = np.minimum(hi, len(names) - window)
                at = np.unique(np.repeat(lo, np.maximum(hi - lo + 1, 0)) + ramp(np.maximum(hi - lo + 1, 0)))
                hashes = [p.of(p.sums(names), at, at + window).view(np.int64) for p in powers]
                rows = [pa.array(hashes[0]), pa.array(hashes[1]), pa.array(np.full(len(at), i, np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(rows, names=["h1", "h2", "doc_id", "key", "lo"])

    return work


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cross the network compressed."""
    zip_ = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [zip_((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])


def _cut(window: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            total, gone, digest, text = [], [], [], []
            for z, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = unzip(z).split()
                total.append(len(words))
                kept, out = words, 0
                if spans:
                    lo, hi = (np.array([s[k] for s in spans], np.int64) for k in ("lo", "hi"))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.minimum(lo, len(words)), 1)
                    np.add.at(edge, np.minimum(hi + window, len(words)), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    out = int((~stay).sum())
                    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(out)
                joined = b" ".join(kept)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    text.append(joined.decode("utf-8", "surrogatepass"))
            cols = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string())] if with_text else cols, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return work


def repeated_spans(docs: DataFrame, window: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, key, lo, hi): the windows starting at words lo to hi of a row also start in a document with a smaller doc_id. docs: doc_id, key, text."""
    shared = docs.mapInArrow(_anchor_rows(window, rounds, False), "name long, doc_id long").groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("name")
    rows = docs.mapInArrow(_anchor_rows(window, rounds, True), "name long, doc_id long, key long, width int, block long, lo array<int>")
    rows = materialize(rows.join(shared, "name"), "blocks")
    by_block = rows.groupBy("name", "block").agg(F.min("doc_id").alias("first"))
    several = by_block.groupBy("name").agg(F.min("block").alias("x"), F.max("block").alias("y")).select("name", (F.col("x") < F.col("y")).alias("several"))
    # written apart, so that adaptive execution can split the rows of a common block in the join
    known = materialize(by_block.join(several, "name"), "block-firsts")
    judged = materialize(rows.join(known, ["name", "block"]).select("doc_id", "key", "lo", "width", "several", (F.col("doc_id") > F.col("first")).alias("repeat")), "judged")
    judged = judged.select("doc_id", "key", "several", "repeat", "width", F.explode("lo").alias("lo")).withColumn("hi", F.col("lo") + F.col("width"))
    # rows that repeat both id and text give equal spans, which count once
    unsure = judged.where("not repeat and several").groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    texts = docs.where("doc_id is not null").mapInArrow(_pack, "doc_id long, key long, packed binary")
    windows = materialize(texts.join(unsure, ["doc_id", "key"]).mapInArrow(_window_rows(window), "h1 long, h2 long, doc_id long, key long, lo int"), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    late = windows.join(least, ["h1", "h2"]).where("doc_id > first").select("doc_id", "key", "lo", F.col("lo").alias("hi"))
    return judged.where("repeat").select("doc_id", "key", "lo", "hi").unionByName(late)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, with with_text also kept_text.

    Null and empty texts have no words. Rows without an id keep all words and lend none. Rows that share an id lend each
    other nothing, and each loses only what its own text repeats of smaller ids; positions belong to a row's text, which is
    named by a 64-bit hash. Equal texts: all windows of the later ids go. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = repeated_spans(source, window, rounds).groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    texts = source.mapInArrow(_pack, "doc_id long, key long, packed binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(spans, ["doc_id", "key"], "left").mapInArrow(_cut(window, with_text), schema)
