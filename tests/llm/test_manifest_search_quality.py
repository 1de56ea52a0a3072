"""Merkle manifest, lexical search and quality against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscan.llm import catalog, lexical, merkle, quality

ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "LOREM ipsum " * 30_000), (5, "LOREM ipsum " * 30_000), (6, "Ärger a@b.co \x00 'X' \"y\" 日本"), (None, "one")]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). {place in rows: all columns}."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaves = [sha(*map(part, r)) for r in rows]
    bad = [sha(*map(part, (*r[:4], lower(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else x for r, x in zip(rows, leaves, strict=True)]

    def tree(nodes):
        """(root, proof of each leaf as (before, after) by level)."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for i, p in enumerate(at):
                run = level[p // 8 * 8 : p // 8 * 8 + 8]
                steps[i].append((run[: p % 8], run[p % 8 + 1 :]))
            level, at = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)], [p // 8 for p in at]
        return level[0], steps

    by_lang = defaultdict(list)
    for i, r in enumerate(rows):
        by_lang[r[2]].append(i)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])
    own = {x: (sorted(by_lang[x], key=key)) for x in langs}
    trees = {x: tree([leaves[i] for i in own[x]]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = {}
    for k, x in enumerate(langs):
        for pos, i in enumerate(own[x]):
            steps = trees[x][1][pos] + tops[k]
            folded = bad[i]
            for before, after in steps:
                folded = sha(*before, folded, *after)
            out[i] = (rows[i][0], x, pos, leaves[i], trees[x][0], root, sha(*(s for a, b in steps for s in a + b)), folded, folded == root)
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "lang", "pos", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 8}, {"a": 9, None: 1}, {"a": 65, "b": 64, None: 3, "é": 1, "": 2}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_op11_trees(spark, counts):
    rows = [(i * 7 % 1009, None if i % 5 == 0 else f"s{i}", x, i if i % 4 else None, None if i % 11 == 0 else f"Text Ä {i}") for i, x in enumerate(x for x, n in counts.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    got = merkle.audit(spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' as pos", "'y' as leaf", "'z' as tree", "1 as total"))
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_manifest(rows).values()))


def test_op11_odd_rows(spark):
    rows = [(i, "s", "en", 1, t) for i, t in ROWS]
    assert sorted(map(str, map(tuple, merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()))) == sorted(map(str, plain_manifest(rows).values()))
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op11_finds_what_was_changed(spark):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(40)]
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.col("doc_id").isin(3, 17), {"n_chars": F.lit(2)}).collect()}
    assert got == {i: i not in (3, 17) for i in range(40)}


def test_op11_leaves_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.audit(spark.createDataFrame([(1, "s", "en", 1, "x")], SCHEMA)).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before and not [t for t in spark.catalog.listTables() if t.name.startswith("merkle")]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        wanted = Counter(plain_terms(text))
        found = []
        for (doc, _), c, size in zip(docs, counts, n, strict=True):
            score = 0
            for t, times in wanted.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def searched(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(str, map(tuple, df.collect())))


def test_op12_terms():
    for text in (None, "", "A-b_C 1É", "x\x7fy\x00z", "日本 [Ab]`{c}~ÀÖ¡", "é e"):
        assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("tree_terms,block", [(400_000, 256), (300, 3)])
def test_op12_random(spark, make, tree_terms, block):
    rnd = random.Random(4)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rnd.choice((1, 5, 30, 200))))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (7, docs[9][1])]
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 40)))) for i in range(12)] + [(50, None), (51, "..."), (52, docs[3][1]), (52, "w1"), (53, "absent")]
    got = lexical.top_documents(make(docs).repartition(3), make(items, "item_id"), block_items=block, tree_terms=tree_terms)
    assert searched(got) == plain_search(docs, items)


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_op12_tree_bounds_and_pruning(bucket):
    rng = np.random.default_rng(2)
    paths = [np.sort(rng.choice(60, rng.integers(1, 20), replace=False)) for _ in range(400)] + [np.arange(5)] * 50
    counts = [rng.integers(1, 9, len(p)) for p in paths]
    m = rng.integers(25, 300, len(paths))
    tree = lexical.Tree(np.arange(len(paths)), np.zeros(len(paths), bool), m, paths, counts, bucket)
    weights, matrix = rng.integers(1, 9000, 60), np.zeros((60, 7))
    for i in range(7):
        matrix[rng.choice(np.arange(40, 60), 4, replace=False), i] = 1
    best = lexical.Best(7, 10)
    scored = lexical.search(tree, matrix, weights, best)
    dense = np.zeros((len(paths), 60), np.int64)
    for k, (p, c) in enumerate(zip(paths, counts, strict=True)):
        dense[k, p] = c
    every = (weights * lexical.share(dense, m[:, None])) @ matrix.astype(np.int64)
    for i in range(7):
        assert sorted((-s, -d) for s, _, d in best.heaps[i]) == sorted((-int(every[k, i]), k) for k in range(len(paths)) if every[k, i])[:10]
    assert scored < len(paths) * 7


def test_op12_odd_rows(spark, make):
    assert searched(lexical.top_documents(make(ROWS), make([(1, "ONE lorem"), (2, None), (None, "日本")], "item_id"))) == plain_search(ROWS, [(1, "ONE lorem"), (None, "日本")])
    for docs, items in (([], [(1, "one")]), (ROWS, []), ([(1, None)], [(1, "one")])):
        assert searched(lexical.top_documents(make(docs), make(items, "item_id"))) == []


@pytest.mark.parametrize("name", sorted({"op11_merkle_manifest", "op12_lexical_search"}))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.sql(catalog.ORACLE[name])
    got = catalog.queries()[name](spark, sf_dir)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_op13_trees_against_single_steps():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x, y, rounds=30, depth=3)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.values, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + math.exp(-total))

    got = trees.scores(x)
    assert np.allclose(got, [walk(r) for r in x]) and ((got >= 0.5) == y).mean() > 0.97


def test_op13_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=200) > 0.5).astype(float)
    tree = quality.grow(x, y, rounds=1, depth=1, bins=1000)
    p = (y.sum() + 1) / 202
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(c, t):
        left = x[:, c] <= t
        if min(h[left].sum(), h[~left].sum()) < quality.LEAST:
            return -1
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))

    best = max(gain(c, t) for c in range(3) for t in np.unique(x[:, c]))
    assert math.isclose(gain(int(tree.feature[0, 0]), tree.threshold[0, 0]), best)


def test_op13_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics("AB ab ab!\nx y\nx y\n"), strict=True))
    assert math.isclose(s["chars"], math.log1p(18)) and math.isclose(s["words"], math.log1p(7)) and math.isclose(s["lines"], math.log1p(3))
    assert math.isclose(s["upper"], 2 / 18) and math.isclose(s["blanks"], 7 / 18) and math.isclose(s["signs"], 1 / 18)
    assert math.isclose(s["distinct_words"], 5 / 7) and math.isclose(s["commonest_word"], 2 / 7) and math.isclose(s["line_repeats"], 3 / 18) and math.isclose(s["sign_words"], 1 / 7) and math.isclose(s["upper_words"], 1 / 7)
    assert math.isclose(dict(zip(quality.STATISTICS, quality.statistics("a a a b"), strict=True))["word_repeats"], 2 / 4)
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATISTICS)


def test_op13_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{at}/documents.parquet"), known := spark.read.parquet(f"{at}/labels.parquet"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())
    rows = got.where("held_out").join(known, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_op13_odd_rows(spark, make):
    got = quality.classify(make(ROWS), labels(spark, []))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows := got.collect()) == len(ROWS)
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    one = quality.classify(make(ROWS), labels(spark, [(1, 0, 0), (2, 0, 1), (2, 0, 1), (3, None, 0), (None, 1, 0)])).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] < 0.5
    assert quality.classify(make([]), labels(spark, [])).count() == 0


def test_op13_larger_than_the_sample(spark, make):
    docs = [(i, "good words of prose here" if i % 2 else "!!! $$$ ###") for i in range(600)]
    got = quality.classify(make(docs), labels(spark, [(i, i % 2, 0) for i in range(600)]), max_train=200)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got.collect())
