"""Blocked search against all pairs; related events, page types and the frontier against literal cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.functions import urls as U
from loomscan.operators import joins, mapping, ranking, search


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k_is_that_of_all_pairs(spark, block):
    rng, rnd = np.random.default_rng(1), random.Random(1)
    vector = lambda: rnd.choice([None, [], [0.0] * 4, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0], rng.normal(size=4).tolist(), rng.normal(size=4).tolist()])
    rows = [(i, vector(), rnd.choice([0.0, 0.01, 0.05]), rnd.choice([["Paris", None], ["New York"], None, ["york"]])) for i in range(150)]
    queries = [(1000 + i, vector(), rnd.choice([None, None, "york", "N_w%k", "x"])) for i in range(30)]
    schema = "id long, embedding array<double>, bonus double, places array<string>"
    got = search.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, "query long, embedding array<double>, location string"), 5, block)

    def cos(a, b):
        a, b = np.array(a or []), np.array(b or [])
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) and len(a) == len(b) and a.any() and b.any() else 0.0

    fits = {"york": ("New York", "york"), "N_w%k": ("New York",), "x": ()}
    want = {}
    for q, e, location in queries:
        found = sorted((-round(cos(v, e) + bonus, 6), i) for i, v, bonus, places in rows if location is None or any(p in fits[location] for p in places or ()))
        want |= {(q, k + 1): (i, pytest.approx(-s)) for k, (s, i) in enumerate(found[:5])}
    assert {(r["query"], r["place"]): (r["id"], r["score"]) for r in got.collect()} == want


def test_bonuses(spark):
    rows = [(1, "artist", [1.0], 100, 200, None), (2, "artist", [1.0], None, 50, None), (3, "exhibition", [1.0], 10, 0, dt.datetime(2024, 1, 10)), (4, "exhibition", [1.0], 10, 0, dt.datetime(2023, 1, 10))]
    records = spark.createDataFrame(rows, "id long, record_type string, embedding array<double>, completeness_score int, confidence_score int, created_at timestamp")
    query = spark.createDataFrame([(9, [2.0], None)], "query long, embedding array<double>, location string")
    assert {r["id"]: r["score"] for r in search.semantic_artists(records, query).collect()} == {1: 1.2, 2: 1.05}
    assert {r["id"]: r["score"] for r in search.semantic_exhibitions(records, query, "timestamp '2024-05-01 00:00:00'").collect()} == {3: 1.06, 4: 1.01}


def test_questions(spark):
    records = spark.createDataFrame([(1, "artist", "Paris", [0.0] * 96, 10, 0)], "id long, record_type string, city string, embedding array<double>, completeness_score int, confidence_score int")
    asked = spark.createDataFrame([(1, "Similar painters in the north in  paris "), (2, "painters in Rome"), (3, "painters")], "query long, text string")
    got = {r["query"]: (r["intent"], r["location"], r["id"]) for r in search.ask(records, asked).collect()}
    assert got == {1: ("artist_similarity", "paris", 1), 2: ("semantic_lookup", "Rome", None), 3: ("semantic_lookup", None, 1)}


@pytest.mark.parametrize("block", [4096, 16])
def test_related_artists_are_those_of_all_pairs(spark, block):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    pick = lambda *v: rnd.choice(v)
    vector = lambda: pick(None, [], [0.0] * 3, [1.0, 0.0, 0.0], [1.0, 2.0], rng.normal(size=3).tolist(), rng.normal(size=3).tolist())
    lists = lambda: [pick(None, [], ["a"], ["a", "b"], ["c", None, "c"]) for _ in range(3)]
    rows = [(i, vector(), pick("", "Rome", "rome", None), pick("IT", "FR", None), pick("it", None), *lists()) for i in range(150)]
    names = ["embedding", "city", "country", "nationality", "exhibitions", "articles", "press"]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, city string, country string, nationality string, exhibitions array<string>, articles array<string>, press array<string>")
    q = df.where("id % 5 = 0").select(F.col("id").alias("anchor"), *[F.col(c).alias(f"a_{c}") for c in names])
    score = F.round(0.6 * S.cosine_similarity(F.col("embedding"), F.col("a_embedding")) + 0.25 * ranking.related_overlap("", "a_") + 0.15 * ranking.location_similarity("", "a_"), 5)
    every, want = df.crossJoin(q).where("id <> anchor").select("anchor", "id", score.alias("score")).where("score > 0").collect(), set()
    for a in range(0, 150, 5):
        best = sorted((-r["score"], r["id"]) for r in every if r["anchor"] == a)[:7]
        want |= {(a, i, -s, n) for n, (s, i) in enumerate(best, 1)}
    got = [tuple(r) for r in ranking.related_artists(df, df.where("id % 5 = 0"), 7, block).collect()]
    assert len(got) == len(want) and set(got) == want


def test_related_artists_has_no_join_of_all_rows(spark):
    df = spark.createDataFrame([(1, [1.0], "", "", "", ["a"], ["a"], ["a"])], "id long, embedding array<double>, city string, country string, nationality string, exhibitions array<string>, articles array<string>, press array<string>")
    plan = ranking.related_artists(df, df, 2)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_spread_join_deals_large_keys_and_loses_no_pair(spark):
    left = spark.createDataFrame([(i, "a" if i < 80 else None if i == 99 else str(i % 7)) for i in range(100)], "id long, key string")
    right = spark.createDataFrame([(i, "a" if i < 50 else str(i % 9)) for i in range(70)], "list_id long, key string")
    want = sorted(map(tuple, left.join(right, "key").select("key", "id", "list_id").collect()))
    got = joins.spread_join(left, "id", right, "list_id", 100)
    assert sorted(map(tuple, got.select("key", "id", "list_id").collect())) == want
    sizes = [n for n, in got.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert max(sizes) < 4000 / 4  # one task had all 4,000 pairs of the key before


def test_related_events_by_title_alone(spark):
    venues = spark.createDataFrame([(1, " Hall "), (2, "hall"), (3, "Dome"), (4, ""), (5, None)], "id long, title string")
    events = spark.createDataFrame([(11, "HALL"), (12, "hall "), (13, "hall"), (14, ""), (15, "Pier")], "id long, venue_name string")
    got = {(r["side"], r["id"]): (r["venue"], r["event"], r["matches"]) for r in joins.related_events(venues, events).collect()}
    assert got == {("venue", 1): (1, 11, 3), ("venue", 2): (1, 11, 3), ("event", 11): (1, 11, 2), ("event", 12): (1, 11, 2), ("event", 13): (1, 11, 2)}


def test_related_events_of_blank_titles(spark):
    venues = spark.createDataFrame([(1, "  "), (2, " "), (3, ""), (4, None), (5, "Pier")], "id long, title string")
    events = spark.createDataFrame([(11, None), (12, ""), (13, " "), (14, "pier")], "id long, venue_name string")
    got = {(r["side"], r["id"]): (r["venue"], r["event"], r["matches"]) for r in joins.related_events(venues, events).collect()}
    blank = {("venue", i): (1, 11, 3) for i in (1, 2)} | {("event", i): (1, 11, 2) for i in (11, 12, 13)}  # none before
    assert got == blank | {("venue", 5): (5, 14, 1), ("event", 14): (5, 14, 1)}


def test_related_events_give_the_pairs_of_the_former_join(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("city"))
    rows = joins.related_events(e.select("id", "title"), e.select("id", F.col("title").alias("venue_name")))
    side = lambda x, c: rows.where(F.col("side") == x).select(F.col("id").alias(c), "venue", "event")
    pairs = side("venue", "a").join(side("event", "b"), ["venue", "event"]).select("a", "b")
    k = e.select(F.col("id").alias("a"), F.lower(F.trim("title")).alias("k"), "city")
    assert k.join(k.withColumnRenamed("a", "b"), ["k", "city"]).select("a", "b").exceptAll(pairs).isEmpty()


def test_related_events_lose_no_match(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    got = joins.related_events(e, e.withColumnRenamed("title", "venue_name")).where("side = 'venue'").agg(F.sum("matches")).first()[0]
    k = e.select(F.lower(F.trim("title")).alias("k"))
    assert got == k.join(k, "k").count()


@pytest.mark.parametrize(
    ("candidate", "confidence", "pattern", "want"),
    [
        ("event", 0.8, "/x", ("exhibition", False)), ("generic_detail", 0.72, "/artists/{slug}", ("detail", False)), ("venue", 0.9, "/artists", ("generic", False)), ("listing", 0.5, "/artists", ("artist", True)), ("artist", 0.5, "/artists", ("artist", False)),
        ("listing", 0.1, "/news", ("listing", False)), ("listing", 0.1, "/a/b/c", ("detail", True)), ("odd", 0.1, "/a/b", ("generic", False)), ("document", 0.2, "/files/x.pdf", ("document", False)), ("artwork", 0.2, "/works/{num}", ("artwork", False)), ("listing", 0.2, "/whats-on/shows", ("exhibition", True)),
    ],
)
def test_page_types_of_families(spark, candidate, confidence, pattern, want):
    kind, conflict = U.resolve_page_type(F.lit(candidate), F.lit(confidence), F.lit(pattern))
    assert tuple(spark.range(1).select(kind.alias("a"), conflict.alias("b")).first()) == want


def test_family_rules(spark):
    rows = [("s", "/news/archive", "listing", 0.9, 5), ("s", "/events/{slug}", "event", 0.9, 5), ("s", "/past-year/{num}", "generic_detail", 0.5, 1), ("s", "/login", "listing", 0.9, 9)]
    got = {r["pattern"]: (r["page_type"], r["include"], r["follow"], r["priority"], r["freshness"], r["escalate"]) for r in mapping.family_rules(spark.createDataFrame(rows, "source_id string, pattern string, page_type string, confidence double, size long")).collect()}
    assert got == {
        "/news/archive": ("listing", True, True, "high", "daily", False), "/events/{slug}": ("exhibition", True, False, "medium", "weekly", False),
        "/past-year/{num}": ("generic", False, False, "low", "monthly", True), "/login": ("listing", False, True, "high", "daily", False),
    }


def test_failing_fields_are_ranked_in_each_source(spark):
    rows = [("a", f"f{i:02}") for i in range(12) for _ in range(1 + i // 2)] + [("b", "x"), ("b", ""), ("b", None)]
    got = [tuple(r) for r in ranking.top_failing_fields(spark.createDataFrame(rows, "source_id string, field string")).orderBy("source_id", "place").collect()]
    best = ["f10", "f11", "f08", "f09", "f06", "f07", "f04", "f05", "f02", "f03"]
    assert got == [("a", n, f, 1 + int(f[1:]) // 2) for n, f in enumerate(best, 1)] + [("b", 1, "x", 1)]  # b had no row before


def test_requeue_ranks_discovered_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "discovered", t, None), (2, "a", "discovered", t - dt.timedelta(1), None), (3, "a", "failed_retryable", t, None), (4, "b", "fetched", t, None), (5, "b", "discovered", t, None)]
    got = {r["id"]: (r["status"], r["next_retry_at"] is not None) for r in ranking.requeue(spark.createDataFrame(rows, "id int, source_id string, status string, created_at timestamp, next_retry_at timestamp"), "timestamp '2024-01-02 00:00:00'", 1).collect()}
    assert got == {1: ("discovered", False), 2: ("queued", False), 3: ("queued", True), 4: ("fetched", False), 5: ("queued", False)}
