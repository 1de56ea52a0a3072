"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Around them, tokens that hold a digit or an @ form a graph per document: neighbours in the
text are linked as a chain, and distant tokens that are equal, or similar (same digits, or same name before the @), are
linked by skip edges. Tokens inside base spans are observed; the others have a unary potential by their shape. Loopy
sum-product passes messages until they settle; a token whose best label is a kind with probability of at least
`certain` becomes a span. Unary, chain and skip potentials are counts of the base labels over all documents. What the
field adds is what a pattern alone can't see: a number without its plus sign, or an address cut short, that stands in a
document together with its full form. It adds no span where no linked token is known.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
CERTAIN = 0.8
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match takes whole runs of digits, so it begins where a run does; runs without a point are passed once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"\S+")
_SEED = re.compile(r"[0-9@]")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if not i % 2 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost matches by kind; what fails its check is dropped."""
    out = []
    end = 0
    for m in _AT.finditer(text) if "@" in text else ():
        # the part before an @ can't hold another @, so the leftmost match starts where its run of letters does
        a = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, 0, m.end()))
            end = m.end()
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    digits, letters = sum("0" <= c <= "9" for c in token), sum(c.isalpha() for c in token)
    return f"{'@' in token:d}{token.count('.') if token.count('.') < 4 else 4}{'+' in token:d}{min(digits, 20)}{'L' if letters else ''}{'-' in token:d}"


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label): label 0 if no base span touches the token, else that of the first one that does."""
    out, k = [], 0
    for m in _RUN.finditer(text) if base or _SEED.search(text) else ():
        a, b = m.span()
        if not _SEED.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a == b:
            continue
        while k < len(base) and base[k][2] <= a:
            k += 1
        near = next((x for x in base[k : k + 4] if x[0] < b and x[2] > a), None)
        out.append((a, b, near[1] + 1 if near else 0))
    return out


def skip_edges(words: list[str]) -> list[tuple[int, int]]:
    """Each token with the one before it that is equal or similar; links are as many as tokens, not as pairs."""
    last: dict[str, int] = {}
    out = []
    for i, w in enumerate(words):
        low = w.lower()
        keys = ["=" + low]
        if len(d := "".join(c for c in low if "0" <= c <= "9")) >= 7:
            keys.append("#" + d)
        if "@" in low and low.index("@"):
            keys.append("@" + low[: low.index("@")])
        for j in {last[k] for k in keys if k in last}:
            out.append((j, i))
        for k in keys:
            last[k] = i
    return out


class Field:
    """Potentials of the random field; counts come from base labels."""

    def __init__(self, shapes: dict[str, list[int]], chain: np.ndarray, skip: np.ndarray):
        total = np.array([sum(v[i] for v in shapes.values()) for i in range(len(LABELS))], float) + 0.5
        self.prior = total / total.sum()
        self.unary = {s: self._smooth(np.array(v, float)) for s, v in shapes.items()}
        self.chain = self._ratio(chain)
        self.skip = self._ratio(skip + 2 * np.eye(len(LABELS)))  # links agree unless the sample says otherwise

    def _smooth(self, v: np.ndarray) -> np.ndarray:
        return (v + self.prior) / (v.sum() + 1)

    @staticmethod
    def _ratio(counts: np.ndarray) -> np.ndarray:
        joint = counts + counts.T + 0.5
        joint /= joint.sum()
        side = joint.sum(axis=1)
        return joint / np.outer(side, side)

    def marginals(self, words: list[str], labels: list[int], rounds: int = 30) -> np.ndarray:
        n = len(words)
        unary = np.stack([self.unary.get(shape(w), self.prior) for w in words])
        for i, x in enumerate(labels):
            if x:
                unary[i] = 1e-9
                unary[i, x] = 1.0
        skips = skip_edges(words)
        edges = [(i, i + 1) for i in range(n - 1)] + [(i, j) for i, j in skips if not (labels[i] and labels[j])]
        if not edges:
            return unary / unary.sum(axis=1, keepdims=True)
        chained = n - 1
        a = np.array([e[0] for e in edges] + [e[1] for e in edges])
        b = np.array([e[1] for e in edges] + [e[0] for e in edges])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        skipping = np.tile(np.arange(len(edges)) >= chained, 2)[:, None]
        message = np.full((len(a), len(LABELS)), 1.0 / len(LABELS))
        for _ in range(rounds):
            belief = np.log(unary)
            np.add.at(belief, b, np.log(message))
            out = np.exp(belief[a] - np.log(message[back]) - belief[a].max(axis=1, keepdims=True))
            new = np.where(skipping, out @ self.skip, out @ self.chain)
            new = np.maximum(new / new.sum(axis=1, keepdims=True), 1e-12)
            settled = np.abs(new - message).max() < 1e-6
            message = 0.5 * message + 0.5 * new
            if settled:
                break
        belief = np.log(unary)
        np.add.at(belief, b, np.log(message))
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def learn(docs: DataFrame) -> Field:
    """Counts over all docs (doc_id, text); what comes back is a row for each token shape and pair of labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = text or ""
                got = tokens_of(text, base_spans(text))
                labels, words = [x[2] for x in got], [text[a:b] for a, b, _ in got]
                found.update(f"u {shape(w)} {x}" for w, x in zip(words, labels, strict=True))
                found.update(f"c {x} {y}" for x, y in zip(labels[:-1], labels[1:], strict=True))
                found.update(f"s {labels[i]} {labels[j]}" for i, j in skip_edges(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["what", "n"])

    shapes, chain, skip = {}, np.zeros((5, 5)), np.zeros((5, 5))
    rows = docs.select("text").mapInArrow(count, "what string, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()  # shapes and label pairs only
    for r in sorted(rows, key=lambda r: r["what"]):
        kind, x, y = r["what"].split(" ")
        if kind == "u":
            shapes.setdefault(x, [0] * len(LABELS))[int(y)] += r["n"]
        else:
            (chain if kind == "c" else skip)[int(x), int(y)] += r["n"]
    return Field(shapes, chain, skip)


def all_spans(text: str, field: Field, certain: float = CERTAIN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, base and added) spans as (start, kind, end)."""
    base = base_spans(text)
    got = tokens_of(text, base)
    if all(x for _, _, x in got):
        return base, base
    p = field.marginals([text[a:b] for a, b, _ in got], [x for _, _, x in got])
    best = p.argmax(axis=1)
    added = [(a, int(best[i]) - 1, b) for i, (a, b, x) in enumerate(got) if not x and best[i] and p[i, best[i]] >= certain]
    return base, sorted(base + added)


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans; spans holds all, as kind:start:end by start and kind, in code points. Null and
    empty texts have none (the digest is that of the empty string). Repeated rows and null ids are no special case; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    field = learn(source)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "", field)
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                digests.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
                spans.append(_text_of(every))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(n[:, i]) for i in range(4)], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return source.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets, and n_chars counted anew; other columns as they are. Null texts stay null."""
    field = learn(docs.select("doc_id", F.col("text").cast("string").alias("text")))

    @F.pandas_udf("string")
    def mask(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, k, b in all_spans(text, field)[1]:
                if a >= at:
                    out += [text[at:a], f"<{KINDS[k].upper()}>"]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one, na_action="ignore")

    hidden = docs.withColumn("text", mask(F.col("text").cast("string")))
    return hidden.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden
