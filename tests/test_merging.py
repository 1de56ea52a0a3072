"""Literal cases of merging by field, and loops over records in order."""

import json
import random

import pytest

from loomscan.operators import merging as M

FIELD = "id int, field string, value string, items array<string>, confidence double, source string"


def fields(spark, rows):
    return spark.createDataFrame(rows, FIELD)


def test_each_rule_of_a_merge(spark):
    old = [(1, "year", "1980", None, 90.0, "p1"), (1, "city", "Rome", None, 50.0, "p1"), (1, "bio", None, None, None, None), (1, "name", "A", None, 60.0, "p1"), (1, "mediums", None, ["oil", "ink"], 40.0, "p1"), (1, "kept", "x", None, 70.0, "p1"), (1, "gone", "y", None, 10.0, "p1"), (1, "collections", None, ["a"], 5.0, "p1")]
    new = [(1, "year", "1982", None, 92.0, "p2"), (1, "city", "Oslo", None, 51.0, "p2"), (1, "bio", "text", None, 20.0, "p2"), (1, "name", "A", None, 80.0, "p2"), (1, "mediums", None, ["ink", "wax", "wax"], 30.0, "p2"), (1, "kept", "z", None, 70.0, "p2"), (1, "gone", None, None, 99.0, "p2"), (1, "extra", "e", None, 7.0, "p2"), (1, "collections", None, ["a"], 9.0, "p2")]
    merged = M.merge_fields(fields(spark, old), fields(spark, new))
    got = {r["field"]: (r["value"] if r["items"] is None else r["items"], r["confidence"], r["source"], r["rule"]) for r in merged.collect()}
    assert got == {
        "year": ("1980", 90.0, "p1", "high_conflict_no_overwrite"), "city": ("Oslo", 51.0, "p2", "higher_confidence"), "bio": ("text", 20.0, "p2", "fill_null"), "name": ("A", 80.0, "p1", None), "mediums": (["oil", "ink", "wax"], 40.0, "p2", "array_union"),
        "kept": ("x", 70.0, "p1", None), "gone": ("y", 10.0, "p1", None), "extra": ("e", 7.0, "p2", "fill_null"), "collections": (["a"], 9.0, "p2", None),
    }
    assert {(r["field"], r["value"], r["source"], r["confidence"], r["selected"]) for r in M.field_conflicts(merged).collect()} == {("year", "1980", "p1", 90.0, True), ("year", "1982", "p2", 92.0, False)}
    snapshot = json.loads(M.merge_snapshots(fields(spark, old), fields(spark, new), merged).first()["snapshot"])
    assert snapshot["before"] == {"year": "1980", "city": "Rome", "bio": None, "name": "A", "mediums": ["oil", "ink"], "kept": "x", "gone": "y", "collections": ["a"]} and snapshot["after"]["city"] == "Oslo" and snapshot["after"]["mediums"] == ["oil", "ink", "wax"]
    assert snapshot["incoming"]["gone"] is None and snapshot["changes"] == {"year": "high_conflict_no_overwrite", "city": "higher_confidence", "bio": "fill_null", "mediums": "array_union", "extra": "fill_null"}


def test_records_come_into_an_entity_as_in_a_loop(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.choice(["a", "b"]), i // 2, i, rnd.choice(["x", "y", "z", "", None]), rnd.choice([0.1, 0.5, 0.5, 0.9])) for i in range(200)]
    fields_, conflicts = M.merge_into_entities(spark.createDataFrame(rows, "entity_id int, field string, seq int, record_id int, value string, confidence double"))
    value, entries, noted = {}, {}, []
    for e, f, _, r, v, c in rows:
        if not v:
            continue
        best = max((x for x in entries.get((e, f), [])), default=0.0)
        if (e, f) not in value:
            value[e, f] = v
        elif value[e, f] != v:
            noted.append((e, f, r, value[e, f], v, "replaced" if c >= best else "kept_existing"))
            value[e, f] = v if c >= best else value[e, f]
        entries.setdefault((e, f), []).append(c)
    assert {(r["entity_id"], r["field"]): (r["value"], r["confidence"], r["entries"]) for r in fields_.collect()} == {k: (v, max(entries[k]), len(entries[k])) for k, v in value.items()}
    assert sorted(map(tuple, conflicts.collect())) == sorted(noted) and noted


def test_rows_of_one_record_come_into_an_entity_by_place(spark):
    rows = [(1, "a", 1, 11, "x", 0.5, "f", 0), (1, "a", 2, 21, "p", 0.7, "f", 9), (1, "a", 2, 21, "z", 0.7, "f", 3), (1, "a", 2, 21, "y", 0.6, "g", 1), (1, "a", 3, 31, "w", 0.1, "f", 5)]
    want = [(1, "a", 21, "x", "z", "replaced"), (1, "a", 21, "z", "p", "replaced"), (1, "a", 21, "z", "y", "kept_existing"), (1, "a", 31, "z", "w", "kept_existing")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "entity_id int, field string, seq int, record_id int, value string, confidence double, file string, place long")
        assert sorted(map(tuple, M.merge_into_entities(df)[1].collect())) == sorted(want)


def test_losers_fill_gaps(spark):
    rows = spark.createDataFrame([(1, "a", None, 0.1), (2, "a", "two", 0.2), (3, "a", "three", 0.3), (1, "b", "one", 0.4), (3, "b", "tri", 0.5), (9, "a", "nine", 0.6)], "id long, field string, value string, confidence double")
    got = {(r["id"], r["field"]): (r["value"], r["confidence"], [tuple(p) for p in r["provenance"]], r["merged_ids"]) for r in M.merge_entity_data(rows, spark.createDataFrame([(2, 1), (3, 1)], "id long, winner long")).collect()}
    assert got == {(1, "a"): ("two", 0.2, [(2, "two"), (3, "three")], [2, 3]), (1, "b"): ("one", 0.4, [(1, "one"), (3, "tri")], [2, 3]), (9, "a"): ("nine", 0.6, [(9, "nine")], [])}


def test_merges_of_rows_and_edges_are_undone_in_turn(spark):
    records = spark.createDataFrame([(1, "", None, 5), (2, "b", "u2", 9), (3, "c", None, 1), (4, "d", "u4", 2), (5, "e", "u5", 3)], "id int, city string, url string, score int")
    edges = spark.createDataFrame([(1, 2, "x", 0.5), (2, 3, "x", 0.4), (1, 3, "x", 0.6), (3, 2, "y", 0.7), (4, 5, "x", 0.1), (2, 2, "z", 0.2)], "from_id int, to_id int, edge_type string, confidence double")
    key = ["from_id", "to_id", "edge_type"]
    pairs = lambda *p: spark.createDataFrame(p, "primary int, secondary int")
    r1, e1, rl1, el1 = M.merge_rows(records, edges, pairs((1, 2)), ["city", "url"], ["score"], 1)
    assert sorted(map(tuple, r1.collect())) == [(1, "b", "u2", 9), (3, "c", None, 1), (4, "d", "u4", 2), (5, "e", "u5", 3)]
    assert sorted(map(tuple, e1.collect())) == [(1, 3, "x", 0.6), (3, 1, "y", 0.7), (4, 5, "x", 0.1)]
    r2, e2, rl2, el2 = M.merge_rows(r1, e1, pairs((3, 1), (4, 99)), ["city", "url"], ["score"], 2)
    assert sorted(map(tuple, r2.collect())) == [(3, "c", "u2", 9), (4, "d", "u4", 2), (5, "e", "u5", 3)] and sorted(map(tuple, e2.collect())) == [(4, 5, "x", 0.1)]
    back_r, back_e = M.undo(r2, rl2, 2, ["id"]), M.undo(e2, el2, 2, key)
    assert sorted(map(tuple, back_r.collect())) == sorted(map(tuple, r1.collect())) and sorted(map(tuple, back_e.collect())) == sorted(map(tuple, e1.collect()))
    assert sorted(map(str, M.undo(back_r, rl1, 1, ["id"]).collect())) == sorted(map(str, records.collect())) and sorted(map(str, M.undo(back_e, el1, 1, key).collect())) == sorted(map(str, edges.collect()))


def test_pages_of_an_artist(spark):
    rows = [
        ("f", 1, "u1", "artist_profile", "name", "Jo"), ("f", 2, "u2", "artist_profile", "name", "Jo Brown"), ("f", 3, "u3", "artist_press", "name", " Jo Brown "), ("f", 4, "u4", "artist_press", "name", "Al Brown"), ("f", 5, "u5", "artist_press", "name", ""),
        ("f", 1, "u1", "artist_biography", "bio", "a long text"), ("f", 2, "u2", "artist_biography", "bio", "new"), ("f", 3, "u3", "artist_profile", "bio", "short"), ("f", 4, "u4", "artist_profile", "website_url", None), ("g", 1, "u9", "artist_profile", "website_url", "w"),
    ]
    got = {(r["family"], r["field"]): (r["value"], r["sources"], r["conflicts"]) for r in M.payload_fields(spark.createDataFrame(rows, "family string, seq int, url string, page_type string, field string, value string")).collect()}
    assert got == {
        ("f", "artist_name"): ("Jo Brown", ["u1", "u2", "u3", "u4"], ["Al Brown", "Jo", "Jo Brown"]), ("f", "bio_full"): ("new", ["u1", "u2"], []), ("f", "bio_short"): ("short", ["u3"], []), ("g", "website"): ("w", ["u9"], []),
    }
    lists = spark.createDataFrame([("f", 2, "u2", "news", 0, "b"), ("f", 1, "u1", "news", 1, "c"), ("f", 1, "u1", "news", 0, "b"), ("f", 3, "u3", "news", 0, None), ("f", 2, "u2", "news", 1, "a")], "family string, seq int, url string, field string, place int, item string")
    assert [(r["items"], r["sources"]) for r in M.payload_lists(lists).collect()] == [(["b", "c", "a"], ["u1", "u2"])]


@pytest.mark.parametrize("parts", [1, 5])
def test_running_maximum(spark, parts):
    from pyspark.sql import functions as F

    from loomscan.plans.prefix import with_running_max

    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), i, rnd.randrange(50)) for i in range(300)]
    got = with_running_max(spark.createDataFrame(rows, "g string, i int, v int").repartition(parts), ["g"], ["i"], F.struct("v", "i"), "m").collect()
    for r in got:
        before = [(v, i) for g, i, v in rows if g == r["g"] and i < r["i"]]
        assert (tuple(r["m"]) if r["m"] else None) == max(before, default=None)
