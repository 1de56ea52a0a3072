"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import time

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomscan.llm import decontamination, embeddings, licenses, packing, personal_data, recompression, simhash, token_counts, toxicity, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (5, LONG), (6, LONG + "end"), (None, "one"), (7, "é日本 a@b.co \x00 'x' \"y\"")]


def rows(df):
    return [r.asDict() for r in df.collect()]


def labels(spark, data=()):
    return spark.createDataFrame(list(data), "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, d: decontamination.contaminated(d, spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "two")], "item_id long, text string")),
    "op2": lambda spark, d: simhash.near_duplicates(d),
    "op3": lambda spark, d: personal_data.find(d),
    "op4": lambda spark, d: token_counts.count_tokens(d, VOCABULARY, chunk_chars=1000),
    "op5": lambda spark, d: warc.round_trip(spark, d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), "key", "record", "chunk")),
    "op6": lambda spark, d: recompression.remove_repeats(d),
    "op7": lambda spark, d: licenses.scan(d, licenses.template_rows(spark)),
    "op9": lambda spark, d: packing.best_fit(d),
    "op10": lambda spark, d: toxicity.classify(d, labels(spark)),
}
PER_ROW = ("op2", "op3", "op4", "op5", "op6", "op10")


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, make, name):
    assert OPERATORS[name](spark, make([])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, make, name):
    got = rows(OPERATORS[name](spark, make(ROWS)))
    if name in PER_ROW:
        key = "page_id" if name == "op5" else "doc_id"
        assert sorted(str(r[key]) for r in got) == sorted(str(i) for i, _ in ROWS)


def test_op1(spark, make):
    got = {(r["doc_id"], r["item_id"]) for r in rows(OPERATORS["op1"](spark, make(ROWS)))}
    assert got == {(4, 1)}


def test_op2(spark, make):
    got = {r["doc_id"]: r for r in rows(simhash.near_duplicates(make(ROWS)))}
    assert got[1]["fingerprint"] == "0" * 16 and {got[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert got[None]["component_id"] == 4 and got[5]["component_id"] == 5


def test_op5(spark, make):
    got = {r["page_id"]: r for r in rows(OPERATORS["op5"](spark, make([*ROWS, (9, LONG)])))}
    assert got[9]["record_type"] == "revisit" and got[9]["refers_to"] == 5 and got[5]["record_type"] == "response"
    assert got[9]["payload_bytes"] == len(LONG) and got[9]["payload_digest"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert got[1]["payload_bytes"] == 0 and got[2]["record_type"] == "response" and got[7]["payload_bytes"] == len(ROWS[-1][1].encode())


def test_op6(spark, make):
    got = {r["doc_id"]: r for r in rows(recompression.remove_repeats(make(ROWS), with_text=True))}
    assert got[5]["n_removed"] == 0 and got[5]["n_words"] == 60_000
    assert got[6]["kept_text"] == "end" and got[1]["n_words"] == 0 and got[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_op8(spark, make):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    data = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, a), (7, a), (8, b), (9, [0.0, 1.0, 0.0]), (10, [1.0, 0.0]), (None, a), (11, [float("inf"), 0.0, 0.0])]
    got = {r["vec_id"]: r for r in rows(embeddings.near_duplicates(make(data, "vec_id", "embedding", "array<float>")))}
    assert len(got) == len(data) and got[6]["n_links"] == 2 and got[7]["n_links"] == 2 and got[8]["component_id"] == 6
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1, 2, 3, 4, 5, 9, 10, 11)) and not got[7]["kept"] and not got[None]["kept"]
    assert embeddings.near_duplicates(make([], "vec_id", "embedding", "array<float>")).count() == 0


def test_op9(spark, make):
    got = rows(packing.best_fit(make(ROWS)))
    assert sum(r["length"] for r in got) == sum(len((t or "").encode()) for _, t in ROWS)
    assert all(r["bin_id"] is None for r in got if not r["length"])
    bins = {}
    for r in got:
        if r["length"]:
            bins.setdefault((r["bin_id"], r["capacity"], r["bin_used"]), []).append((r["bin_offset"], r["length"]))
    for (_, capacity, used), inside in bins.items():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at == used <= capacity


def test_packing_downsizes_to_contents():
    bins, offsets, down = packing.pack([900, 100, 20], (128, 1024, 4096), overhead=1)
    assert sum(down) <= 1024 + 128 and offsets[0] == 0 and len(bins) == 3


def test_long_texts_take_linear_time():
    field = personal_data.Field({}, np.zeros((5, 5)), np.zeros((5, 5)))
    lexicon = toxicity.Lexicon({" scum": 1.0})
    start = time.perf_counter()
    for text in ("ab" * 500_000, "1" * 500_000, "1." * 150_000, "@" * 200_000 + "a@b" * 50_000, "+1((((" * 50_000, "pond scum " * 50_000):
        personal_data.all_spans(text, field)
        toxicity.Lexicon.features(lexicon.automaton(), text)
    assert time.perf_counter() - start < 30
    assert toxicity.Lexicon.features(lexicon.automaton(), "pond scum, scum")[0] == 1.0


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from loomscan.plans.shared import shared_dir

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with labels and a benchmark."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "what is the third prime number after ten please"), (2, None), (None, "a b c")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


TAUGHT = [(i, f"the {'grobble ' * 3 if i % 2 else ''}river number {i} runs {chr(97 + i % 26)} on and on to sea {i * 7}") for i in range(400)]


def test_stages_judge_each_row_by_its_text(spark, make, corpus):
    bad, leak = "oh grobble grobble grobble", "Q: What is the third prime number after ten, please?"
    docs = make([*TAUGHT, (None, bad), (None, leak), (None, None), (900, ""), (901, bad), (901, "fine and good words"), (902, leak), (902, LONG), (902, LONG), (903, "jo@mail.example.com and 10.0.0.1")])
    clean = corpus_pipeline.drop_toxic(spark, docs, corpus)
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert clean.columns == docs.columns and (901, "fine and good words") in left and (None, None) in left and (900, "") in left and left.count((902, LONG)) == 2
    assert not any("grobble" in (t or "") for _, t in left) and sum(i is not None and i < 400 for i, _ in left) == 200
    free = corpus_pipeline.drop_leaks(spark, docs, corpus)
    left = [(r["doc_id"], r["text"]) for r in free.collect()]
    assert free.columns == docs.columns and len(left) == len(TAUGHT) + 8 and not any(t == leak for _, t in left) and left.count((902, LONG)) == 2
    masked = corpus_pipeline.mask_personal_data(spark, docs, corpus)
    got = {(r["doc_id"], r["text"]) for r in masked.collect()}
    assert masked.columns == docs.columns and (903, "<EMAIL> and <IP>") in got and (None, None) in got and masked.count() == docs.count()
    assert sum(r["length"] for r in corpus_pipeline.pack(spark, docs, corpus).collect()) == sum(len((r["text"] or "").encode()) for r in docs.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_without_rows(spark, make, corpus, stage):
    docs = make([])
    out = stage(spark, docs, corpus)
    assert out.columns == docs.columns and out.count() == 0


def test_pipeline_end_to_end(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"] for r in rows}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.classify(source, labels).collect() if r["predicted"]}
    leaks = {r["doc_id"] for r in decontamination.contaminated(source, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert not kept & (toxic | leaks) and kept <= set(docs)
    w = {i: t.lower().split() for i, t in docs.items() if i not in toxic}
    sets = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for i, x in w.items()}
    least = {i: i for i in sets}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(close)):
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    assert kept == {i for i in sets if least[i] == i} - leaks
    for r in rows:
        assert r["bin_id"] is None or r["bin_offset"] + r["length"] <= r["bin_used"] <= r["capacity"]


def test_pipeline_guard():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()
