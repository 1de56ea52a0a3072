"""Proposals and previews on literal rows, and previews against a plain loop."""

import random

from loomscan.operators import mapping as M

ROW = "version_id int, sort_order long, selector string, sample_value string, destination_entity string, destination_field string, category_target string, confidence double, status string, is_enabled boolean"


def test_proposals(spark):
    clusters = spark.createDataFrame([("s", "detail_event", "Event", 0.9, "Site"), ("s", "root_page", "Home", 0.47, "Site"), ("s", "odd", "Odd", 0.8, None)], "source_id string, key string, label string, confidence double, source_name string")
    got = {(r["key"], r["rank"]): r for r in M.proposals(clusters).collect()}
    assert sorted((k, r["selector"], r["entity"], r["field"], r["sample"], r["confidence"]) for k, r in got.items()) == [
        (("detail_event", 0), "h1", "event", "title", "sample_title", 0.9), (("detail_event", 1), "time, .date", "event", "start_date", "sample_start_date", 0.85), (("detail_event", 2), ".description, article p", "event", "description", "sample_description", 0.8),
        (("odd", 0), "title", "organization", "title", None, 0.8), (("odd", 1), "meta[name='description']", "organization", "description", "sample_description", 0.75), (("root_page", 0), "title", "organization", "title", "Site", 0.47), (("root_page", 1), "meta[name='description']", "organization", "description", "sample_description", 0.45),
    ]
    assert got["detail_event", 1]["rationale"] == "Cluster 'Event' mapped to schema blueprint 'detail_event'; Selector 'time, .date' commonly captures 'start_date'"


def plain(rows):
    """One version's preview by a loop over its rows in order."""
    n, record, sources, categories, warnings = 0, {}, {}, {}, []
    for _, _, selector, sample, entity, field, category, confidence, status, enabled in sorted(rows, key=lambda r: r[1]):
        if not enabled or status == "rejected":
            continue
        n, value = n + 1, (sample or "").strip()
        if value:
            record[field or ""] = value
            seen = sources.setdefault(field or "", [])
            if selector not in seen:
                seen.append(selector)
            if (confidence or 0) < 0.65:
                warnings.append(f"Low confidence extraction for {entity}.{field}")
        if category:
            seen = categories.setdefault(entity or "", [])
            if category not in seen:
                seen.append(category)
    return n, record, sources, categories, warnings


def test_previews_equal_a_loop(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    rows = [(k % 6, k, pick("h1", "h2", None), pick(" a ", "b\n", "", None, "\t", "c"), pick("artist", "event", None), pick("title", "bio", None), pick("x", "y", "", None), pick(0.2, 0.64, 0.65, 0.9, None), pick("approved", "rejected", None), pick(True, True, False, None)) for k in range(300)]
    got = {r["version_id"]: (r["n_rows"], list(r["record"].items()), list(r["sources"].items()), list(r["categories"].items()), r["warnings"]) for r in M.mapping_preview(spark.createDataFrame(rows, ROW).repartition(4)).collect()}
    for v in range(6):
        n, *maps, warnings = plain([r for r in rows if r[0] == v])
        assert (n, *(dict(m) for m in got[v][1:4]), got[v][4]) == (n, *maps, warnings)
    assert M.mapping_preview(spark.createDataFrame([], ROW)).count() == 0


def test_row_warnings(spark):
    rows = [(1, 1, "h1", " ", "e", "f", None, 0.1, None, True), (1, 2, "h1", "x", "e", "f", None, None, "draft", True), (1, 3, "h1", "x", "e", "f", None, 0.65, "draft", True), (1, 4, "h1", "x", "e", "f", None, 0.1, "rejected", True)]
    assert [(r["sort_order"], r["value"], r["warning"]) for r in M.preview_rows(spark.createDataFrame(rows, ROW)).orderBy("sort_order").collect()] == [(1, None, "Empty sample value"), (2, "x", "Low confidence mapping - moderation required"), (3, "x", None)]
