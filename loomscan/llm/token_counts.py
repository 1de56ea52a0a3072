"""Token counts from a byte-pair vocabulary compiled to a deterministic transducer.

The transducer reads characters. Its outer state says where in a pretoken it stands (a run of letters, digits, others or
blanks, or an apostrophe that may begin a contraction); its inner state reads the bytes of the pretoken: for each earlier
cut from which a vocabulary entry can still grow, the entry's place in the vocabulary's prefix tree, the last token before
the cut and the token count there, relative to now. Each transition carries the change of the token count. Of all entries
that end at a byte just one can follow the last token before it (merging both again gives back the two), which makes the
transducer deterministic; states are made when first met and kept.

A long text is cut into chunk rows, which Spark deals to tasks. A chunk's state map takes each state in which the chunk
may be entered to the state in which it is left and the tokens in between. Where blanks stand in the chunk or before it, one
entry state is possible; in long runs without any, the states that the characters before the chunk can lead to, from each
place where a token could have begun. Maps are composed in order, neighbours in groups of a fixed size, level by level, as
in a prefix scan. A text of which a map lacks a state that is needed is read again from its start, in one pass.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.llm.runs import repeated
from loomscan.plans.shared import materialize

CHUNK_CHARS = 1 << 14
CONTEXT = 512
FAN_IN = 64
#: Pretokens of up to so many characters are known again by a hash of powers, which longer ones can be built to share.
NAMED_CHARS = 64
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_KEPT = 1 << 20


@cache
def _vocabulary(path: str) -> tuple[list[str], dict[tuple[bytes, bytes], int], dict[int, int], dict[int, bytes], int]:
    """(special strings, ranks of merges, prefix tree, tokens by node, longest token) of a vocabulary file, read once a worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    to_bytes = {c: bytes([b]) for b, c in letters.items()}
    rank: dict[tuple[bytes, bytes], int] = {}
    words = {bytes([b]) for b in range(256)}
    for i, pair in enumerate(spec["model"]["merges"]):
        a, b = (b"".join(to_bytes[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
        rank[a, b] = i
        words.add(a + b)
    child: dict[int, int] = {}
    token: dict[int, bytes] = {}
    nodes = 1
    for word in sorted(words):  # nodes have the same numbers in every task
        at = 0
        for b in word:
            key = at << 8 | b
            if key not in child:
                child[key], nodes = nodes, nodes + 1
            at = child[key]
        token[at] = word
    return [x["content"] for x in spec["added_tokens"]], rank, child, token, max(map(len, words))


class Transducer:
    """Byte transducer of a byte-level vocabulary file; count(pretoken bytes) is the number of its tokens."""

    def __init__(self, path: str):
        self.specials, self.rank, self.child, self.token, self.longest = _vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.known: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank.get
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fit(self, a: bytes, b: bytes) -> bool:
        if (got := self.fits.get((a, b))) is None:
            got = self.fits[a, b] = self._merged(a + b) == [a, b]
        return got

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, last, change = [], None, 0
        for node, before, count in self.states[state]:
            if (to := self.child.get(node << 8 | byte)) is None:
                continue
            grown.append((to, before, count))
            if last is None and (word := self.token.get(to)) is not None and (before is None or self._fit(before, word)):
                last, change = word, count + 1
        key = (*((n, t, c - change) for n, t, c in grown), (0, last, 0))
        if (to := self.known.get(key)) is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = to, change
        return to, change

    def count(self, data: bytes) -> int:
        if len(self.states) > _KEPT:
            self.reset()
        return self.read(0, data)[1]

    def number(self, key: tuple) -> int:
        """The number of a state that may come from another task."""
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.states)
            self.states.append(key)
        return at

    def read(self, state: int, data: bytes) -> tuple[int, int]:
        """(state after the bytes, change of the token count)."""
        total = 0
        moves = self.moves
        for byte in data:
            step = moves.get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return state, total


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


@cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = _SPACE
    return out


@cache
def _weights() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, 1 << 16, dtype=np.uint64)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def pretoken_starts(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pretokens of texts laid end to end; edges: the texts' starts."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[edges[edges < n]] = True
    edge[n] = True
    change = np.r_[True, kind[1:] != kind[:-1]] | edge[:n]
    start = change.copy()
    space = kind == _SPACE
    # before a text the last blank of a run goes with it if it is U+0020, and is a pretoken of its own otherwise
    last_blank = np.r_[space[:-1] & ~space[1:] & ~edge[1:n], False]
    start |= last_blank
    glued = np.flatnonzero(last_blank & (code == 32)) + 1
    start[glued] = False
    # an apostrophe that is a whole run, begins a match, and is followed by one of the endings
    lone = np.flatnonzero((code == 39) & start)
    lone = lone[lone + 1 < n]
    lone = lone[(kind[lone + 1] == _LETTER) & ~edge[lone + 1]]
    for at in lone.tolist():
        for end in _CONTRACTIONS:
            stop = at + 1 + len(end)
            if stop <= n and all(code[at + 1 + i] == ord(c) and (not i or not edge[at + 1 + i]) for i, c in enumerate(end)):
                start[at + 1] = False
                if stop < n:
                    start[stop] = True
                break
    return np.flatnonzero(start)


class Counter:
    """Counts tokens of many texts at a time; pretokens already met are looked up."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.special = re.compile("|".join(map(re.escape, sorted(self.transducer.specials, key=len, reverse=True)))) if self.transducer.specials else None
        self.seen: dict[int, int] = {}

    def counts(self, texts: list[str], split: bool = True) -> np.ndarray:
        """Tokens of each text; special strings inside count one each, unless they are split off already."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            for piece, specials in self.pieces(text) if split else ((text, 0),):
                out[i] += specials
                parts.append(piece)
                owner.append(i)
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= 1 << 19):
                size += len(parts[end])
                end += 1
            np.add.at(out, np.array(owner[at:end]), self._plain(parts[at:end]))
            at = end
        return out

    def _plain(self, texts: list[str]) -> np.ndarray:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0, *map(len, texts)])
        start = pretoken_starts(code, edges[:-1])
        if not len(start):
            return np.zeros(len(texts), np.int64)
        end = np.r_[start[1:], len(code)]
        up, down = _powers(1 << max(20, int(len(code)).bit_length()))
        weight = _weights()[code & 0xFFFF] ^ (code >> 16).astype(np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(weight * up[: len(code)], dtype=np.uint64)]
        names = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
        short = np.flatnonzero(end - start <= NAMED_CHARS)
        unique, first, back = np.unique(names[short], return_index=True, return_inverse=True)
        if len(self.seen) > 2 * _KEPT:
            self.seen.clear()
        seen, found = self.seen, np.empty(len(unique), np.int64)
        counted = lambda at: self.transducer.count(joined[start[at] : end[at]].encode("utf-8", "surrogatepass"))
        for i, (name, at) in enumerate(zip(unique.tolist(), short[first].tolist(), strict=True)):
            got = seen.get(name)
            if got is None:
                got = seen[name] = counted(at)
            found[i] = got
        tokens = np.zeros(len(start), np.int64)
        tokens[short] = found[back]
        for at in np.flatnonzero(end - start > NAMED_CHARS).tolist():
            tokens[at] = counted(at)
        per = np.r_[0, np.cumsum(tokens)]
        cut = np.searchsorted(start, edges)
        return per[cut[1:]] - per[cut[:-1]]

    def text_state(self, entry: str) -> tuple[int, str, int]:
        """A state as text to (where in a pretoken, characters held back, inner state)."""
        if not entry:
            return _NONE, "", 0
        mode, held, inner = json.loads(entry)
        return mode, held, self.transducer.number(tuple((node, None if t is None else bytes.fromhex(t), n) for node, t, n in inner))

    def state_text(self, state: tuple[int, str, int]) -> str:
        mode, held, inner = state
        if mode == _NONE:
            return ""
        return json.dumps([mode, held, [[node, None if t is None else t.hex(), n] for node, t, n in self.transducer.states[inner]]], separators=(",", ":"))

    def read(self, state: tuple[int, str, int], text: str) -> tuple[tuple[int, str, int], int]:
        """(state after the text, change of the token count), character by character."""
        mode, held, inner = state
        kinds, total = _classes(), 0

        def feed(at: int, part: str) -> int:
            nonlocal total
            at, change = self.transducer.read(at, part.encode("utf-8", "surrogatepass"))
            total += change
            return at

        for c in text:
            kind = int(kinds[ord(c)])
            if mode == _QUOTE:
                if held + c in _ENDED:
                    feed(0, held + c)
                    mode, held, inner = _NONE, "", 0
                    continue
                if held == "'" and c in _BEGUN:
                    held += c
                    continue
                inner = feed(0, "'")
                if held == "'":
                    mode = _OTHER
                else:
                    mode, inner = _LETTER, feed(0, held[1])
                held = ""
            elif mode == _SPACE:
                if kind == _SPACE:
                    inner, held = feed(inner, held), c
                    continue
                if held == " ":
                    mode, held, inner = kind, "", feed(feed(0, " "), c)
                    continue
                feed(0, held)
                mode, held, inner = _NONE, "", 0
            if mode == kind:
                inner = feed(inner, c)
            elif kind == _SPACE:
                mode, held, inner = _SPACE, c, 0
            elif c == "'":
                mode, held, inner = _QUOTE, c, 0
            else:
                mode, held, inner = kind, "", feed(0, c)
        return (mode, held, inner), total

    def finish(self, state: tuple[int, str, int]) -> int:
        """What the characters held back add where the text ends."""
        mode, held, inner = state
        if mode == _SPACE:
            return self.transducer.read(inner, held.encode())[1]
        return sum(self.transducer.read(0, c.encode())[1] for c in held)

    def entries(self, context: str, whole: bool) -> list[str]:
        """The states that a chunk after the context can be entered in; whole: the context begins where the text does."""
        cuts = _cuts(context)
        if len(cuts):
            context, whole = context[cuts[-1] :], True
        starts = [0] if whole else range(min(self.transducer.longest, max(1, len(context) - 1)))
        return sorted({self.state_text(self.read((_NONE, "", 0), context[i:])[0]) for i in starts})

    def state_map(self, text: str, entries: list[str], last: bool) -> list[tuple[str, str, int]]:
        """(entry state, exit state, tokens) of a chunk for each entry state; the last chunk of a text leaves in the first state."""
        if len(self.transducer.states) > _KEPT:
            self.transducer.reset()
        cuts = _cuts(text)
        inside, rest = 0, text
        if len(cuts):
            inside, rest = int(self.counts([text[cuts[0] : cuts[-1]]], split=False)[0]), text[cuts[-1] :]
            after, more = self.read((_NONE, "", 0), rest)
            inside += more
        out = []
        for entry in entries:
            at, n = self.read(self.text_state(entry), text[: cuts[0]] if len(cuts) else text)
            if len(cuts):
                n, at = n + self.finish(at) + inside, after
            out.append((entry, "", n + self.finish(at)) if last else (entry, self.state_text(at), n))
        return out

    def whole(self, text: str) -> int:
        """Tokens of a text, read from its start in one pass that keeps no more than the state."""
        total = 0
        for piece, specials in self.pieces(text):
            state, n = self.read((_NONE, "", 0), piece)
            total += n + self.finish(state) + specials
        return total

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """(text between special strings, special strings before it)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], int(at > 0)
            at = m.end()
        yield text[at:], int(at > 0)


_NONE, _QUOTE = -1, -2
_ENDED = frozenset("'" + x for x in _CONTRACTIONS)
_BEGUN = frozenset(x[0] for x in _CONTRACTIONS if len(x) > 1)


def _cuts(text: str) -> np.ndarray:
    """Where a blank follows another character: the pretoken before it has ended, whatever it was."""
    space = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == _SPACE
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


_MAP = "array<struct<entry:string,exit:string,n:bigint>>"
_KEYS = ["doc_id", "h1", "h2"]


def _composed(maps: Column) -> Column:
    """The map of neighbours in order: each entry state of the first is followed through the others; null where one lacks it."""
    rest = F.slice(maps, 2, F.greatest(F.size(maps) - 1, F.lit(0)))

    def follow(e: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            hit = F.get(F.filter(m, lambda x: x["entry"] == acc["exit"]), F.lit(0))
            return F.struct(hit["exit"].alias("exit"), (acc["n"] + hit["n"]).alias("n"))

        end = F.aggregate(rest, F.struct(e["exit"].alias("exit"), e["n"].alias("n")), step)
        return F.struct(e["entry"].alias("entry"), end["exit"].alias("exit"), end["n"].alias("n"))

    return F.transform(F.get(maps, F.lit(0)), follow)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk_chars: int = CHUNK_CHARS, fan_in: int = FAN_IN, context: int = CONTEXT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level vocabulary file, the same on every executor. Null texts count as empty: no bytes,
    no tokens. Texts of at most chunk_chars characters are one chunk each. Long rows that repeat both id and text are read
    once and returned as often as they stand. Ids may be null; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    one = F.char_length("text") <= chunk_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            n = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            for row in range(batch.num_rows):
                k, chunks = 0, []
                for piece, specials in counter.pieces(batch.column("text")[row].as_py()):
                    for at in range(0, max(1, len(piece)), chunk_chars):
                        chunks.append((k, piece[at : at + chunk_chars], piece[max(0, at - context) : at], at <= context, at + chunk_chars >= len(piece), specials if not at else 0))
                        k += 1
                key = batch.select([*_KEYS, "n_bytes"]).slice(row, 1)
                for at in range(0, len(chunks), 64):
                    part = [pa.array(c, t) for c, t in zip(zip(*chunks[at : at + 64], strict=True), (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()), strict=True)]
                    same = pa.array(np.zeros(len(part[0]), np.int64))
                    yield pa.RecordBatch.from_arrays([*[c.take(same) for c in key.columns], *part], names=[*_KEYS, "n_bytes", "k", "text", "context", "whole", "last", "specials"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        kind = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            maps = []
            for t, c, whole, last, specials in zip(*(batch.column(x).to_pylist() for x in ("text", "context", "whole", "last", "specials")), strict=True):
                entries = counter.entries(c, whole) if c else [""]
                maps.append([{"entry": a, "exit": b, "n": n + specials} for a, b, n in counter.state_map(t, entries, last)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*_KEYS, "n_bytes", "k")], pa.array(maps, kind)], names=[*_KEYS, "n_bytes", "k", "map"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            n = [counter.whole(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    schema = "doc_id long, n_bytes long, n_tokens long"
    counted = source.where(one).select("doc_id", "n_bytes", "text").mapInArrow(short, schema)
    # named by id and text, so that a task that runs again gives its chunks the same names
    long_ = source.where(~one).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "n_bytes", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = "doc_id long, h1 long, h2 long, n_bytes long, k int"
    chunks = long_.mapInArrow(cut, f"{keys}, text string, context string, whole boolean, last boolean, specials long").repartition(parts, "h1", "k")
    level = chunks.mapInArrow(mapped, f"{keys}, map {_MAP}").groupBy(*_KEYS, "n_bytes", "k").agg(F.first("map").alias("map"), F.count("*").alias("copies"))
    level = materialize(level, "chunk-maps")
    most = level.agg(F.max("k")).first()[0]
    while most:
        group = level.groupBy(*_KEYS, "n_bytes", F.floor(F.col("k") / fan_in).cast("int").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "map"))).alias("maps"), F.first("copies").alias("copies"))
        level = group.select(*_KEYS, "n_bytes", "k", _composed(F.transform("maps", lambda x: x["map"])).alias("map"), "copies")
        most //= fan_in
    long_counts = materialize(level.select(*_KEYS, "n_bytes", F.get("map", F.lit(0))["n"].alias("n_tokens"), "copies"), "long-counts")
    counted = counted.unionByName(repeated(long_counts.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens", "copies"), "copies"))
    open_ = long_counts.where("n_tokens is null").select("h1", "h2").distinct()
    if open_.limit(1).count():
        counted = counted.unionByName(long_.join(open_, ["h1", "h2"], "left_semi").select("doc_id", "n_bytes", "text").mapInArrow(again, schema))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
