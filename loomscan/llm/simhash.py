"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints, so pairs within `radius` bits lie within `radius`
in the embedding. The embedding is cut into zones, and the allowed distance is dealt to the zones as a pigeonhole
sum: for radius 4, two zones in which the pair differs by at most 1, or one zone in which it differs by 0. Within a
zone, the grid range-join of width 1 is an equi-join on the zone's counts with one coordinate left out: counts at
distance 1 differ in one coordinate only. Cells are then verified by exact Hamming distance.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.components import connected_components
from loomscan.llm.runs import bounds, key_runs, ramp
from loomscan.plans.shared import materialize

SEGMENT_BITS = 2
CELL_LIMIT = 8192
SEED = 42
_BLOCK = 1 << 16


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    end = (start + size - 1)[shingle - 1 :].tolist()
    start = start[: len(end)].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(end), _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + _BLOCK], end[at : at + _BLOCK], strict=True)], np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > len(end)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text; null and empty texts get 0, short texts count as one shingle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([_fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, fp long")


def _popcounts(fp: np.ndarray, bits: int) -> np.ndarray:
    """Rows of fingerprints to their counts by segment."""
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(fp), 64 // bits, bits).sum(axis=2, dtype=np.uint8)


def _embedded(fp: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """Segment counts in unary: the bits of each segment sorted. Differing bits of two of them are their Manhattan distance."""
    own = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(fp), 64 // bits, bits)
    return np.packbits(np.sort(own, axis=2).reshape(len(fp), 64), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def zones(radius: int, segments: int) -> list[tuple[range, int]]:
    """Zones of segments with the distance each allows, 0 or 1: the sum of (allowed + 1) is radius + 1."""
    allowed = [1] * ((radius + 1) // 2) + [0] * ((radius + 1) % 2)
    cuts = np.linspace(0, segments, len(allowed) + 1).round().astype(int)
    return [(range(a, b), r) for a, b, r in zip(cuts[:-1], cuts[1:], allowed, strict=True)]


def _mixed(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of counts."""
    out = (values.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _cell_keys(radius: int, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(7).integers(1, 2**63, (64, 64 // bits + 1), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            fp, node = batch.column(0), batch.column(1)
            counts = _popcounts(np.ascontiguousarray(fp.to_numpy()), bits)
            keys, part = [], 0
            for zone, allowed in zones(radius, 64 // bits):
                own = counts[:, zone.start : zone.stop]
                for left_out in [None, *range(len(zone))] if allowed and len(zone) else [None]:
                    if allowed and left_out is None:
                        continue  # every masked cell holds the equal ones too
                    cols = [i for i in range(len(zone)) if i != left_out]
                    keys.append(_mixed(np.c_[own[:, cols], np.full(len(own), part, np.uint8)], weights[part, : len(cols) + 1]))
                    part += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.concat_arrays([fp] * len(keys)), pa.concat_arrays([node] * len(keys))], names=["cell", "fp", "node"])

    return work


def _close(fp: np.ndarray, counts: np.ndarray, a, b, radius: int) -> np.ndarray:
    """Which pairs are within radius: Manhattan distance of the segment counts, a lower bound, then the exact Hamming distance."""
    near = np.bitwise_count(counts[a] ^ counts[b]) <= radius
    near[near] = np.bitwise_count((fp[a] ^ fp[b])[near]) <= radius
    return near


def _forest(fp: np.ndarray, counts: np.ndarray, node: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that join what is within radius inside one cell: at most one less than members, never all pairs."""
    left = np.arange(len(fp))
    u, v = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        root = node[queue[0]]
        while queue and len(left):
            at = queue.pop()
            near = _close(fp, counts, left, at, radius)
            if near.any():
                got = left[near]
                left = left[~near]
                queue.extend(got)
                u.extend(node[got])
                v.extend([root] * len(got))
    return u, v


def _joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the least member it is linked to, directly or by others."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _links(radius: int, small: int = 256, pairs: int = 1 << 21):
    def cells(table: pa.Table) -> pa.RecordBatch | None:
        fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        counts = _embedded(fp)
        start, end = bounds(table.column("at").to_numpy())
        size = end - start
        u, v = [], []
        few = np.flatnonzero((size > 1) & (size <= small))
        for part in np.split(few, np.searchsorted(np.cumsum(size[few] ** 2), np.arange(pairs, (size[few] ** 2).sum(), pairs))) if len(few) else []:
            if not len(part):
                continue
            inside = ramp(size[part])
            member = np.repeat(start[part], size[part]) + inside
            after = np.repeat(size[part], size[part]) - inside - 1
            left = np.repeat(np.arange(len(member)), after)
            right = left + 1 + ramp(after)
            hit = _close(fp, counts, member[left], member[right], radius)
            if hit.any():
                label = _joined(left[hit], right[hit], len(member))
                moved = np.flatnonzero(label != np.arange(len(member)))
                u.append(node[member[moved]])
                v.append(node[member[label[moved]]])
        for a, b in zip(start[size > small].tolist(), end[size > small].tolist(), strict=True):
            x, y = _forest(fp[a:b], counts[a:b], node[a:b], radius)
            u.append(np.array(x, np.int64))
            v.append(np.array(y, np.int64))
        if not u:
            return None
        links = np.unique(np.c_[np.concatenate(u), np.concatenate(v)], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return lambda batches: key_runs(batches, "at", cells)


def link_fingerprints(prints: DataFrame, radius: int = 4, cell_limit: int = CELL_LIMIT, bits: int = SEGMENT_BITS) -> DataFrame:
    """(fp, node), fp distinct, to links (u, v) between nodes that join all that is within radius bits, directly or by others."""
    return _link_cells(prints.select("fp", "node").mapInArrow(_cell_keys(radius, bits), "cell long, fp long, node long"), radius, cell_limit)


def _link_cells(cells: DataFrame, radius: int, cell_limit: int) -> DataFrame:
    """Links of (cell, fp, node) that join, inside each cell, what is within radius.

    A cell of more than cell_limit fingerprints is dealt to blocks, and each pair of blocks is compared in its own
    task, so that no task holds more than about two blocks; cells at or below it stay whole. Members link to the least
    node they reach in the cell, so that cells of the same members give the same links.
    """
    hot = cells.groupBy("cell").count().where(F.col("count") > cell_limit).select("cell", F.ceil(F.col("count") / cell_limit).cast("int").alias("blocks"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("fp", "node"), F.col("blocks")).cast("int")
    pair = F.least(F.col("other"), own).cast("long") * F.col("blocks") + F.greatest(F.col("other"), own)
    dealt = (
        cells.join(hot, "cell", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("other", F.explode(other))
        .select(F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", pair)).alias("at"), "fp", "node")
    )
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "at").sortWithinPartitions("at", "node").mapInArrow(_links(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the least doc_id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other. Rows without an id get a component only through
    rows with one (null if there is none). Repeated rows give repeated rows; other columns are ignored.
    Exact copies collapse to one fingerprint before any comparison.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    component = connected_components(link_fingerprints(distinct.where("node is not null"), radius))
    named = distinct.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies: pairs whose sets of five-word shingles reach a Jaccard similarity, found by wide SimHash fingerprints.

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 8
MISS = 0.02
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1 << 21
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    names = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    out = np.zeros(len(names) - shingle + 1, np.uint64)
    for i, w in enumerate(_odd(shingle, SEED)):
        out += names[i : i + len(out)] * w
    return np.unique(_scrambled(out))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@functools.cache
def _odd(many: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**62, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A SimHash of 64 * words bits of a shingle set: a bit is set if it is in over half of the shingles' hashes."""
    count = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), 4096):
        hashes = _scrambled(_scrambled(own[at : at + 4096, None] * _odd(words, SEED + 1)))
        count += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * count > len(own), bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Plan:
    """How the grid is laid for a number of texts: zones of so many segments of one bit, and the radius of the first word."""

    zones: int
    segments: int
    radius: int

    @staticmethod
    def of(texts: int, similarity: float = SIMILARITY, miss: float = MISS) -> Plan:
        """A zone's segments grow with the logarithm of the texts, so that chance company in a cell does not grow; zones are then
        as many as leave a pair at exactly the similarity without a common cell with probability `miss`.

        The bits of sets of Jaccard similarity s differ with a share of at most arccos(2 s / (1 + s)) / pi. The first word
        takes no part in the zones; the radius is that share of its bits and 2.7 deviations.
        """
        share = math.acos(2 * similarity / (1 + similarity)) / math.pi
        segments = min(32, max(8, round(math.log2(max(texts, 2))) - 3))
        hit = (1 - share) ** segments
        return Plan(math.ceil(math.log(1 / miss) / hit), segments, math.floor(64 * share + 2.7 * math.sqrt(64 * share * (1 - share))))


def _sketches(shingle: int):
    """Named texts to (a, b, n, fp, zones): shingles, the first fingerprint word, and the others that zones take their bits from."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints = [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, shingle)
                n.append(len(own))
                prints.append(wide_fingerprint(own))
            prints = np.array(prints, np.uint64).reshape(-1, WORDS)
            rest = [r.tobytes() for r in prints[:, 1:]]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int32()), pa.array(prints[:, 0].copy().view(np.int64)), pa.array(rest, pa.binary())], names=["a", "b", "n", "fp", "rest"])

    return work


def _zone_cells(plan: Plan):
    """Rows (cell, fp, node): the grid cell of each zone, whose coordinates are the counts of its one-bit segments."""
    draw = np.random.default_rng(SEED + 2)
    bits = np.stack([draw.choice(64 * (WORDS - 1), plan.segments, replace=False) for _ in range(plan.zones)])
    place = np.uint64(1) << np.arange(plan.segments, dtype=np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = np.frombuffer(b"".join(part.column("rest").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                own = np.unpackbits(own, axis=1, bitorder="little")
                for zone, picked in enumerate(bits):
                    cell = _scrambled((own[:, picked].astype(np.uint64) * place).sum(axis=1, dtype=np.uint64) * np.uint64(plan.zones) + np.uint64(zone))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), part.column("fp"), part.column("key")], names=["cell", "fp", "node"])

    return work


def _shingle_rows(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.list_(pa.int64()))], names=["key", "own"])

    return work


def _similar(left: tuple, right: tuple | None, similarity: float, cells: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets at or above the Jaccard similarity, across two blocks or inside one. A side: (values, offsets)."""
    sides = [left, right or left]
    n = [np.diff(o) for _, o in sides]
    values = np.concatenate([v for v, _ in (sides if right else sides[:1])])
    names, back, count = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # what stands in one set only is in no intersection
    shared = int(rank[-1]) + 1 if len(rank) else 0
    backs = [back[: len(left[0])], back[len(left[0]) :] if right else back]
    met = np.zeros((len(n[0]), len(n[1])), np.float32)
    rows = [np.repeat(np.arange(len(k)), k) for k in n]
    width = max(1, cells // max(1, len(n[0]) + len(n[1])))
    for at in range(0, shared, width):
        held = []
        for row, own, k in zip(rows, backs, n, strict=True):
            inside = (count[own] > 1) & (rank[own] >= at) & (rank[own] < at + width)
            m = np.zeros((len(k), min(width, shared - at)), np.float32)
            m[row[inside], rank[own[inside]] - at] = 1
            held.append(m)
        met += held[0] @ held[1].T
    hit = met >= similarity * (n[0][:, None] + n[1][None] - met) - 1e-6
    i, j = np.nonzero(hit)
    keep = i < j if right is None else np.ones(len(i), bool)
    return i[keep], j[keep]


def _verified(similarity: float):
    """Runs of one pair of blocks (at, side, node, sub, own) to links between nodes of different sub."""

    def cell(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        side, node, sub = (table.column(c).to_numpy() for c in ("side", "node", "sub"))
        own = table.column("own").combine_chunks()
        offsets = own.offsets.to_numpy().astype(np.int64)
        values = own.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        parts = []
        for s in np.unique(side):
            at = np.flatnonzero(side == s)
            size = np.diff(offsets)[at]
            parts.append((at, (values[np.repeat(offsets[at], size) + ramp(size)], np.r_[0, np.cumsum(size)])))
        (a, left), (b, right) = parts[0], parts[-1] if len(parts) > 1 else (parts[0][0], None)
        i, j = _similar(left, right, similarity)
        i, j = a[i], b[j]
        new = sub[i] != sub[j]
        i, j = i[new], j[new]
        if not len(i):
            return None
        label = _joined(i, j, len(node))
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

    return lambda batches: key_runs(batches, "at", cell)


def near_copies(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, miss: float = MISS, cell_limit: int = CELL_LIMIT, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(a, b, component): for each distinct text, named by the 128 bits of `text_key`, the least number reachable by links of at least that Jaccard similarity.

    Distinct texts are numbered once they are written; the numbers differ from run to run, the groups don't.

    Words are lower-cased runs between blanks; null and empty texts are one text. Wide SimHash fingerprints meet in the
    grid cells of random zones of segments and are joined within a radius; what they join are loose groups, in which the
    shingle sets decide. Groups of at most block_texts are compared in one task. In larger ones each text is first
    compared with one neighbour; then blocks of texts that are not joined yet are compared pair by pair, so that a group
    of close copies costs one comparison a text and no pair is left out. A pair at exactly the similarity is missed by the
    cells with probability `miss`, closer ones much less often.
    """
    named = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(text_key(F.col("text")).alias("name"), "text").select("name.*", "text")
    # copies collapse here; a number is unique whichever attempt of a task wrote it, and read from the table ever after
    sketch = materialize(named.mapInArrow(_sketches(shingle), "a long, b long, n int, fp long, rest binary").dropDuplicates(["a", "b"]).withColumn("key", F.monotonically_increasing_id()), "near-copies")
    plan = Plan.of(sketch.count(), similarity, miss)
    cells = sketch.where("n > 0").mapInArrow(_zone_cells(plan), "cell long, fp long, node long")
    links = materialize(_link_cells(cells, plan.radius, cell_limit), "near-copies-loose")
    loose = materialize(connected_components(links).withColumnRenamed("node", "key").join(sketch.select("key", "n"), "key"), "near-copies-groups")
    size = loose.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    large = size.where((F.col("texts") > block_texts) | (F.col("shingles") > BLOCK_SHINGLES)).select("component")
    sets = materialize(named.join(sketch.select("a", "b", "key").join(loose.select("key"), "key", "left_semi"), ["a", "b"]).select("key", "text").mapInArrow(_shingle_rows(shingle), "key long, own array<long>").dropDuplicates(["key"]), "near-copies-sets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def judged(rows: DataFrame) -> DataFrame:
        """Links of block pairs: rows (at, side, key, sub)."""
        sent = rows.join(sets, "key").select("at", "side", F.col("key").alias("node"), "sub", "own")
        return sent.repartition(parts, "at").sortWithinPartitions("at", "side", "node").mapInArrow(_verified(similarity), "u long, v long")

    small = loose.join(large, "component", "left_anti").select(F.col("component").alias("at"), F.lit(0).alias("side"), "key", F.col("key").alias("sub"))
    found = materialize(judged(small), "near-copies-small")
    in_large = materialize(loose.join(large, "component", "left_semi"), "near-copies-large")
    if in_large.limit(1).count():
        # each text with one neighbour, then what is not joined by that, in blocks
        one = links.join(in_large.select(F.col("key").alias("u")), "u").groupBy("u").agg(F.min("v").alias("v"))
        pair = one.select(F.xxhash64("u", "v").alias("at"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("key")), F.struct(F.lit(1).alias("side"), F.col("v").alias("key")))).alias("x"))
        first = materialize(judged(pair.select("at", "x.side", "x.key", F.col("x.key").alias("sub"))), "near-copies-first")
        sub = connected_components(first).select(F.col("node").alias("key"), F.col("component").alias("sub"))
        within = materialize(in_large.join(sub, "key", "left").select("key", "n", "component", F.coalesce("sub", "key").alias("sub")), "near-copies-subs")
        rest = materialize(judged(_block_pairs(within, block_texts)), "near-copies-rest")
        found = found.unionByName(first).unionByName(rest)
    joined = connected_components(found).withColumnRenamed("node", "key")
    return sketch.select("a", "b", "key").join(joined, "key", "left").select("a", "b", F.coalesce("component", "key").alias("component"))


def _block_pairs(within: DataFrame, block_texts: int) -> DataFrame:
    """(key, n, component, sub) to (at, side, key, sub): blocks of a component in pairs, but for pairs inside one sub.

    A sub of over half a block has blocks of its own, smaller ones of a component share blocks; block numbers come from hashes.
    """
    per = within.groupBy("component", "sub").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    own = per.where(F.col("texts") > block_texts // 2).select("component", "sub", F.col("sub").alias("of"), "texts", "shingles")
    pool = per.where(F.col("texts") <= block_texts // 2)
    pooled = pool.join(pool.groupBy("component").agg(F.sum("texts").alias("t"), F.sum("shingles").alias("s")), "component").select("component", "sub", F.lit(None).cast("long").alias("of"), F.col("t").alias("texts"), F.col("s").alias("shingles"))
    many = F.ceil(F.greatest(F.col("texts") / block_texts, F.col("shingles") / BLOCK_SHINGLES))
    spread = own.unionByName(pooled).select("component", "sub", "of", F.greatest(many, F.lit(1)).alias("many"))
    dealt = materialize(within.join(spread, ["component", "sub"]).select("key", "component", "sub", "of", F.pmod(F.xxhash64("key", F.lit(3)), F.col("many")).alias("part")), "near-copies-blocks")
    blocks = dealt.select("component", "of", F.xxhash64("component", F.coalesce("of", F.lit(0)), F.col("of").isNull(), "part").alias("block")).distinct()
    a, b = blocks.select("component", F.col("of").alias("of_a"), F.col("block").alias("a")), blocks.select("component", F.col("of").alias("of_b"), F.col("block").alias("b"))
    pairs = a.join(b, "component").where("a <= b and not coalesce(of_a = of_b, false)").select(F.xxhash64("a", "b").alias("at"), F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side"), F.col("b").alias("block"))))).alias("x"))
    own_block = F.xxhash64("component", F.coalesce("of", F.lit(0)), F.col("of").isNull(), "part").alias("block")
    return dealt.select("key", "sub", own_block).join(pairs.select("at", "x.side", "x.block"), "block").select("at", "side", "key", "sub")


def text_key(text: F.Column) -> F.Column:
    """The name of a text, two hashes of 64 bits."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay when one document of each group of near copies is kept, with their columns as they are.

    The least id stays, one without an id only if no document of the group has one; of texts under one id that of least name
    stays. Rows that repeat both id and text stay or go together.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("name")).select("doc_id", "name.*")
    rows = named.join(near_copies(docs, text_col, shingle, similarity), ["a", "b"])
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    best = rows.groupBy("component").agg(F.min(order).alias("best"))
    judged = rows.join(best, "component").where(~(order == F.col("best")))
    doomed = judged.select(F.col("doc_id").alias("__drop_id"), F.struct("a", "b").alias("__drop_key")).distinct()
    same = (text_key(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("__drop_key")) & docs[id_col].cast("long").eqNullSafe(F.col("__drop_id"))
    return docs.join(doomed, same, "left_anti")
