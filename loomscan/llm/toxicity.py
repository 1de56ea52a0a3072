"""Toxicity by a weighted lexicon.

Texts are lower-cased, homoglyphs and digit substitutions are folded to letters, and words are laid out with single
blanks, so that one Aho-Corasick automaton finds whole words and word beginnings. The sum of the weights of the hits,
alone and by length, goes through a logistic curve. Exception phrases void the hits that they cover. Lexicon, weights and
curve are learned from labelled rows: all of them up to max_train, beyond that a sample by a hash of the id. A pattern
enters the lexicon if it stands in at least min_texts toxic texts of these and is three times as common there as in others.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.plans.shared import materialize

MAX_TRAIN = 20_000
MIN_TEXTS = 6
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "clown car", "class clown", "stupid simple", "pond scum", "soap scum", "loser bracket", "pathetic fallacy")
#: Look-alikes of Latin letters, and digits that stand for letters.
_FOLD = str.maketrans("аеорсухіјѕԁԛԝһӏαοερνικτυхηω0134578", "aeopcyxijsdqwhlaoepviktuxnwoleastb")
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[@$](?=\w)")
_LENGTHS = range(4, 13)


def normal(text: str | None) -> str:
    """The folded words of a text, each with one blank before it, and a blank at the end."""
    low = (text or "").lower()
    if "@" in low or "$" in low:
        low = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", low)
    return " " + " ".join(_WORD.findall(low.translate(_FOLD))) + " "


def _patterns(form: str) -> set[str]:
    """Word beginnings and whole words of a normal form, as they stand in it."""
    out = set()
    for w in set(form.split()):
        out.update(f" {w[:k]}" for k in _LENGTHS if k <= len(w))
        out.add(f" {w} ")
    return out


class Lexicon:
    """Weights by pattern, exception phrases, and the curve."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, tuple(normal(x) for x in exceptions), curve

    def automaton(self) -> ahocorasick.Automaton | None:
        found: dict[str, list] = {}
        for p, w in self.weights.items():
            found[p] = [len(p), w, False]
        for p in self.exceptions:
            found[p] = [len(p), found.get(p, [0, 0.0])[1], True]
        made = ahocorasick.Automaton()
        for p, v in found.items():
            made.add_word(p, tuple(v))
        if not found:
            return None
        made.make_automaton()
        return made

    @staticmethod
    def features(made, text: str | None) -> tuple[float, float]:
        """(weight of all hits, words)."""
        form = normal(text)
        hits, spans = [], []
        for end, (size, weight, exception) in made.iter(form) if made else ():
            if exception:
                spans.append((end - size + 1, end))
            elif weight:
                hits.append((end - size + 1, weight))
        if hits and spans:
            start, end = _joined_spans(spans)
            hits = [(at, w) for at, w in hits if (k := bisect_right(start, at)) == 0 or at >= end[k - 1]]
        return sum(w for _, w in hits), form.count(" ") - 1.0


def _joined_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, apart and in order."""
    start, end = [], []
    for a, b in sorted(spans):
        if start and a < end[-1]:
            end[-1] = max(end[-1], b)
        else:
            start.append(a)
            end.append(b)
    return start, end


def _design(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / (np.maximum(words, 0) + 50))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def held_out(id_col) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of labelled documents that are not held out, one row an id: all of them up to max_train, else about so many."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / total))
    rows = docs.join(F.broadcast(known), "doc_id")  # at most about max_train ids
    return materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")


def _chosen(good: dict[str, int]) -> set[str]:
    """Of the patterns and their counts the shortest roots, each grown as long as nine in ten of its texts share the longer form."""
    longer: dict[str, list[str]] = {}
    for q in good:
        longer.setdefault(q[:-1], []).append(q)
    roots, chosen = set(), set()
    for p in sorted(good, key=lambda x: (len(x), x)):
        if any(p[:k] in roots for k in range(1, len(p))):
            continue
        roots.add(p)
        grown = p
        while more := [q for q in longer.get(grown, ()) if good[q] >= 0.9 * good[p]]:
            grown = max(more, key=lambda q: (good[q], q))
        chosen.add(grown)
    return chosen


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, exceptions: tuple[str, ...] = EXCEPTIONS, min_texts: int = MIN_TEXTS) -> Lexicon:
    """The lexicon of (doc_id, text) and labels (doc_id, toxic), from rows that are not held out. No rows, or one class only: an empty lexicon."""
    sample = training_rows(docs, labels, max_train)
    void = [normal(x) for x in exceptions]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(), Counter()]
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                form = normal(text)
                for phrase in void:  # what an exception covers teaches nothing
                    form = form.replace(phrase, " ")
                found[toxic].update(_patterns(form))
            for toxic, counts in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "toxic", "n"])

    n = {x["toxic"]: x["n"] for x in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return Lexicon({}, exceptions)
    per = sample.mapInArrow(count, "pattern string, toxic int, n long").groupBy("pattern").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("df1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("df0"))
    kept = per.where((F.col("df1") >= min_texts) & (F.col("df1") / (F.col("df1") + F.col("df0") + 1.5) >= 0.75)).collect()
    df1, df0 = ({x["pattern"]: x[c] for x in kept} for c in ("df1", "df0"))
    odds = {p: float(np.log((df1[p] + 0.5) / (n[1] + 1)) - np.log((df0[p] + 0.5) / (n[0] + 1))) for p in sorted(_chosen(df1))}
    lexicon = Lexicon({p: w for p, w in odds.items() if w > 0}, exceptions)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lexicon.automaton()
        for batch in batches:
            x = [Lexicon.features(made, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "total", "words"])

    rows = sample.select("toxic", "text").mapInArrow(describe, "toxic int, total double, words double").groupBy("toxic", "total", "words").agg(F.count("*").alias("n")).collect()  # at most about max_train rows
    rows.sort(key=lambda r: (r["toxic"], r["total"], r["words"]))
    repeat = [r["n"] for r in rows]
    column = lambda k: np.repeat(np.array([r[k] for r in rows], float), repeat)
    lexicon.curve = _logistic(_design(column("total"), column("words")), column("toxic"))
    return lexicon


def score_of(text: Column, lexicon: Lexicon) -> Column:
    """The score of a text column; 0 with an empty lexicon."""
    if not lexicon.weights:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = lexicon.automaton()
        for texts in parts:
            x = np.array([Lexicon.features(made, t) for t in texts], float).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_design(x[:, 0], x[:, 1]) @ np.array(lexicon.curve), -30, 30))), dtype="float64")

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have no hits and get the curve's value there; rows without an id are scored and not held out.
    Without labels of both classes every score is 0. Rows of one id count once in learning. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon = learn(source, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), max_train)
    scored = source.select("doc_id", score_of(F.col("text"), lexicon).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns as they are. Each row is judged by its own text, in the pass that reads it."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = learn(source, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), max_train)
    return docs.where(score_of(F.col("text").cast("string"), lexicon) < 0.5)
