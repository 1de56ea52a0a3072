"""Runtime maps against a plain loop over rows, templates read back, presets laid over older maps, drafts, and pages read by the compiled rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomscan.functions.html import page_nodes
from loomscan.operators import presets as P
from loomscan.operators import selectors as S
from loomscan.sources.views import view

ROW = "preset_id long, sort_order long, page_type_key string, page_type_label string, selector string, attribute_name string, extraction_mode string, destination_entity string, destination_field string, category_target string, is_required boolean, is_enabled boolean"
PRESET = "preset_id long, name string, url string"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def row(order, kind, selector, field, preset=1, **more):
    given = {"preset_id": preset, "sort_order": order, "page_type_key": kind, "selector": selector, "destination_field": field, "is_required": False, "is_enabled": True} | more
    return tuple(given.get(n) for n in NAMES)


def put(items, item):
    if item not in items:
        items.append(item)


def plain_map(rows, preset, name, url):
    """The map of one preset by a loop over its rows in order."""
    pages = {}
    for r in sorted((dict(zip(NAMES, r, strict=True)) for r in rows), key=lambda r: r["sort_order"]):
        if r["preset_id"] != preset or not r["is_enabled"]:
            continue
        kind, field, sel = r["page_type_key"] or "unknown", r["destination_field"] or "raw_value", r["selector"]
        page = pages.setdefault(kind, {"label": r["page_type_label"] or kind, "css": {}, "entities": [], "need": [], "follow": [], "paging": [], "assets": [], "roles": {}})
        if r["destination_entity"]:
            put(page["entities"], r["destination_entity"])
        if r["is_required"]:
            put(page["need"], field)
        if not sel:
            continue
        page["css"].setdefault(field, sel)
        low, href = field.lower(), (r["attribute_name"] or "").lower() == "href"
        if any(w in low for w in ("url", "link", "ticket", "website")) or href:
            put(page["follow"], sel)
        if "pagination" in (r["category_target"] or "").lower() or "next" in low or "page" in low:
            put(page["paging"], sel)
        if any(w in low for w in P.ASSETS) or (r["extraction_mode"] or "").lower() in ("image", "asset"):
            put(page["assets"], sel)
            page["roles"][sel] = next((role for word, role in (("document", "document"), ("thumbnail", "thumbnail"), ("hero", "hero"), ("avatar", "profile")) if word in low), "gallery")
            if "href" in sel.lower():
                put(page["follow"], sel)
    return pages


def check(found, pages, preset, name):
    assert found["applied_preset_id"] == preset
    assert found["applied_preset_name"] == name
    assert found["extraction_rules"].keys() == pages.keys()
    for kind, page in pages.items():
        assert list(found["extraction_rules"][kind]["css_selectors"].items()) == list(page["css"].items())
        of = found["page_type_rules"][kind]
        assert (of["page_type_label"], of["page_role"], of["destination_entities"], of["target_record_types"], of["required_fields"]) == (page["label"], kind, page["entities"], page["entities"], page["need"])
        assert found["follow_rules"][kind] == {"selectors": page["follow"], "pagination_selectors": page["paging"], "max_depth": 1}
        assert found["asset_rules"][kind]["selectors"] == page["assets"]
        assert found["asset_rules"][kind]["roles"] == page["roles"]
    records = {}
    for kind, page in pages.items():
        for e in page["entities"]:
            entry = records.setdefault(e, {"page_roles": [], "fields": []})
            put(entry["page_roles"], kind)
            for f in page["css"]:
                put(entry["fields"], f)
    assert found["record_type_rules"] == records


def test_equals_a_loop_over_rows(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [
        row(k, pick("artist_detail", "listing", "", None, "Venue Page", "x'y.z"), pick("h1", "a[HREF]", "img.x", "", None, "ul > li"), pick("title", "Source_URL", "hero_image", "next_page", "", None, "gallery", "avatar", "document"), preset=k % 7,
            page_type_label=pick(None, "", "Label", "Other"), attribute_name=pick(None, "href", "HREF", "src"), extraction_mode=pick("text", "Image", None), destination_entity=pick("artist", "event", "", None), category_target=pick(None, "Pagination"),
            is_required=pick(True, False, None), is_enabled=pick(True, True, False, None))
        for k in range(400)
    ]
    made = P.page_rules(P.row_entries(spark.createDataFrame(rows, ROW).repartition(5)))
    heads = [(k, f"p{k}", "https://a.example.com//") for k in range(7)]
    maps = {r["preset_id"]: json.loads(r["runtime_map"]) for r in P.runtime_maps(made, spark.createDataFrame(heads, PRESET)).collect()}
    for k, name, url in heads:
        check(maps[k], plain_map(rows, k, name, url), k, name)
    again = P.template_entries(spark.createDataFrame([(k, json.dumps(m)) for k, m in maps.items()], "preset_id long, template string"))
    back = {r["preset_id"]: json.loads(r["runtime_map"]) for r in P.runtime_maps(P.page_rules(again), spark.createDataFrame(heads, PRESET)).collect()}
    assert back == maps
    twice = P.page_rules(P.row_entries(spark.createDataFrame(rows + rows, ROW)))
    assert sorted(map(str, twice.collect())) == sorted(map(str, made.collect()))


def test_phases(spark):
    rows = [row(1, "artist_detail", "h1", "name"), row(2, "Venue  Page!", "h1", "name"), row(3, None, "h1", "name"), row(4, "root_page", "h1", "n"), row(5, "détail", "h1", "n"), row(1, "listing", "a", "b", preset=2)]
    made = P.page_rules(P.row_entries(spark.createDataFrame(rows, ROW)))
    got = {r["preset_id"]: json.loads(r["runtime_map"]) for r in P.runtime_maps(made, spark.createDataFrame([(1, "p", "https://a.com/"), (2, "q", ""), (3, "r", "https://b.com")], PRESET)).collect()}
    told = [(p["phase_name"], p["base_url"], p["url_pattern"], p["pagination_type"], p["num_pages"], p.get("page_role")) for p in got[1]["crawl_plan"]["phases"]]
    assert told == [
        ("root", "https://a.com", "/", "none", 1, None), ("crawl_venue_page", "https://a.com", "/venues/", "none", 25, "Venue  Page!"), ("crawl_artist_detail", "https://a.com", "/artists/", "follow_links", 100, "artist_detail"), ("crawl_d_tail", "https://a.com", "/", "none", 25, "détail"),
    ]
    assert got[2]["crawl_plan"]["phases"] == []
    assert [p["phase_name"] for p in got[3]["crawl_plan"]["phases"]] == ["root"]
    assert got[3]["extraction_rules"] == {}


@pytest.mark.parametrize(
    ("kind", "want"),
    [
        ("artist_event", ["/events/", "/event/"]), ("Person", ["/artists/", "/people/"]), ("gallery_exhibition", ["/venues/", "/locations/", "/galleries/"]), ("EXHIBITION", ["/exhibitions/"]), ("artwork_detail", ["/artworks/", "/works/"]), ("artist_directory", ["/artists/", "/people/"]), ("a directory", ["/", "/index", "/list"]), ("", ["/"]),
    ],
)
def test_identifiers(spark, kind, want):
    assert spark.createDataFrame([(kind,)], "k string").select(P.identifiers(F.col("k")).alias("i")).first()["i"] == want


def test_a_preset_over_an_older_map(spark):
    old = {
        "mining_map": {"k": [1, {"z": None}]}, "extraction_rules": {"artist": {"css_selectors": {"name": "h2", "bad": None}, "identifiers": ["/a/"]}},
        "page_type_rules": {"artist": {"page_type_label": "Old", "destination_entities": ["person"], "target_record_types": [], "required_fields": ["q"]}},
        "follow_rules": {"artist": {"selectors": ["nav a"], "pagination_selectors": [], "max_depth": 4}}, "asset_rules": {"artist": {"selectors": ["img"], "roles": {"img": "hero"}}},
        "crawl_plan": {"phases": [{"phase_name": "old", "num_pages": 3}]}, "note": "x",
    }
    rows = [row(1, "artist", "h1", "name", page_type_label="New", destination_entity="artist"), row(2, "artist", "img", "gallery"), row(3, "artist", "a.more", "link"), row(1, "x", "p", "y", preset=2, is_enabled=False), row(1, "x", "p", "y", preset=4)]
    sources = spark.createDataFrame(
        [(1, "https://s.com/", json.dumps(old), 1), (2, "https://t.com", None, 2), (3, "https://u.com", "kept", 1), (4, "", json.dumps(old), 4), (5, "", "{broken", None), (6, "https://v.com", None, 3)],
        "id long, url string, structure_map string, preset_id long",
    )
    presets = spark.createDataFrame([(1, 1, "one"), (2, 2, "two"), (3, 6, "empty"), (4, 4, "four")], "preset_id long, source_id long, name string")
    got = {r["id"]: (r["active_preset_id"], r["structure_map"]) for r in P.preset_apply(sources, presets, spark.createDataFrame(rows, ROW)).collect()}
    assert len(got) == 6
    one = json.loads(got[1][1])
    assert one["mining_map"] == old["mining_map"]
    assert one["note"] == "x"
    assert one["extraction_rules"] == {"artist": {"css_selectors": {"name": "h2", "gallery": "img", "link": "a.more"}, "identifiers": ["/a/", "/artists/", "/people/"]}}
    assert one["page_type_rules"]["artist"] == {"page_type_label": "Old", "page_role": "artist", "destination_entities": ["person", "artist"], "target_record_types": ["artist"], "required_fields": ["q"]}
    assert one["follow_rules"]["artist"] == {"selectors": ["nav a", "a.more"], "pagination_selectors": [], "max_depth": 4}
    assert one["asset_rules"]["artist"] == {"selectors": ["img"], "roles": {"img": "gallery"}}
    assert [p["phase_name"] for p in one["crawl_plan"]["phases"]] == ["root", "crawl_artist"]
    assert one["record_type_rules"] == {"artist": {"page_roles": ["artist"], "fields": ["name", "gallery", "link"]}}
    two = json.loads(got[2][1])
    assert two["extraction_rules"] == {}
    assert [p["phase_name"] for p in two["crawl_plan"]["phases"]] == ["root"]
    assert got[3] == (None, "kept")
    assert json.loads(got[4][1])["crawl_plan"]["phases"] == [{"phase_name": "old", "num_pages": 3}]
    assert got[5] == (None, "{broken")
    assert got[6] == (None, None)


@pytest.mark.parametrize(
    ("template", "errors", "usable", "refusals"),
    [
        (None, ["invalid_json"], False, ["no_rules"]), ("", ["invalid_json"], False, ["no_rules"]), ('"x"', ["invalid_structure"], False, ["no_rules"]), ("null", ["invalid_structure"], False, ["no_rules"]), ("{}", ["missing_crawl_plan", "invalid_structure"], False, ["no_rules"]),
        ('{"crawl_plan": {"phases": [{}]}}', ["invalid_structure"], True, ["no_rules"]), ('{"crawl_plan": {"phases": [{}]}, "page_type_rules": {"a": 1}}', [], True, ["no_rules"]), ('{"crawl_plan": {"phases": [{}]}, "extraction_rules": {"a": {"css_selectors": {}}}}', [], True, ["no_identifiers:a"]),
        ('{"crawl_plan": {"phases": [{}]}, "extraction_rules": {"a": {"identifiers": [" / ", "/ok"], "css_selectors": {"t": "A", "u": ".x"}}}}', [], True, ["broad_identifier:a:/", "broad_selector:a.t"]), ('{"crawl_plan": {"phases": [{}]}, "extraction_rules": {"a.b": {"identifiers": ["/ok"], "css_selectors": {"t\'": "\\t"}}}}', ["invalid_selector_format:a.b.t'"], True, ["empty_selector:a.b.t'"]),
    ],
)
def test_templates(spark, template, errors, usable, refusals):
    got = P.template_validate(spark.createDataFrame([(1, template)], "id int, template string")).first()
    assert (got["errors"], got["ok"], got["usable"], got["refusals"]) == (errors, not errors, usable, refusals)


def test_snapshot_and_clone(spark):
    rows = spark.createDataFrame([(1, 9, "n", "approved", "a", "h1"), (1, 9, "n", "approved", None, "h2"), (1, 9, "n", "draft", "b", "h3"), (2, 9, "taken", "approved", "a", "h4"), (3, 8, "taken", "edited", "a", "h5")], "version_id int, source_id int, name string, status string, page_type_key string, selector string")
    taken = spark.createDataFrame([(9, "taken")], "source_id int, name string")
    head, kept = P.preset_snapshot(rows, ("approved", "edited"), taken)
    assert sorted(map(tuple, head.select("preset_id", "source_id", "name", "row_count", "page_type_count").collect())) == [(1, 9, "n", 2, 1), (3, 8, "taken", 1, 1)]
    assert sorted(r["selector"] for r in kept.collect()) == ["h1", "h2", "h5"]
    versions = spark.createDataFrame([(1, 9, 1, "superseded"), (2, 9, 2, "active"), (4, 9, 3, "draft"), (3, 8, 1, "draft")], "version_id int, source_id int, version_number int, state string")
    drafts, copied = P.clone_to_draft(versions, rows.drop("source_id"))
    assert [tuple(r) for r in drafts.collect()] == [(9, 4, 2, "draft", "{}")]
    assert [(r["source_id"], r["version_number"], r["selector"], r["status"]) for r in copied.collect()] == [(9, 4, "h4", "changed_from_published")]
    signals = spark.createDataFrame([(9, 5), (9, 7), (8, 6)], "source_id int, signal_id int")
    assert [json.loads(r["summary"]) for r in P.clone_to_draft(versions, rows.drop("source_id"), signals)[0].collect()] == [{"drift_triggered": True, "generated_from_signal_id": 7, "based_on_active_mapping_version": 2}]


def test_compiled_rules_read_pages(spark):
    rows = [row(1, "artist", "h1.name", "title"), row(2, "artist", "nav a[href]", "link"), row(3, "artist", "img", "hero_image"), row(4, "listing", "li > a", "source_url")]
    made = P.page_rules(P.row_entries(spark.createDataFrame(rows, ROW)))
    html = '<h1 class="name">Ann</h1><nav><a href="/next">n</a></nav><img src="/i.png"><ul><li><a href="/deep">d</a></li></ul>'
    pages = spark.createDataFrame([(1, "https://h.com/a", html, "artist", 0), (2, "https://h.com/b", html, "listing", 0), (3, "https://h.com/c", html, "none", 0)], "page_id long, url string, html string, page_type string, depth int")
    nodes = page_nodes(pages)
    typed = nodes.join(pages.select("page_id", "page_type"), "page_id")
    read = {r["page_id"]: json.loads(r["data"]) for r in S.selector_extract(pages, typed, P.extraction_table(made).drop("preset_id"), on=("page_type",)).collect()}
    assert read[1]["title"] == "Ann"
    assert read[2].keys() == {"source_url"}
    assert read[3] == {}
    followed = S.follow_links(pages, nodes, P.follow_table(made).drop("preset_id")).collect()
    assert sorted((r["page_id"], r["target"], r["depth"]) for r in followed) == [(1, "https://h.com/next", 1), (2, "https://h.com/deep", 1)]
    assert [(r["page_id"], r["asset"]) for r in S.asset_urls(pages, nodes, P.asset_table(made).drop("preset_id").drop("role")).collect()] == [(1, "https://h.com/i.png")]


def test_empty_tables(spark, sf_dir):
    rows = view(spark, sf_dir, "mapping_rows_v").limit(0)
    made = P.page_rules(P.row_entries(rows))
    assert made.count() == 0
    assert P.runtime_maps(made, spark.createDataFrame([], PRESET)).count() == 0
    assert P.template_validate(view(spark, sf_dir, "templates_v").limit(0)).count() == 0


@pytest.mark.parametrize(("name", "most"), [("runtime_map", 1), ("template_export", 2)])
def test_rows_of_presets_are_dealt_once(spark, sf_dir, name, most):
    plan = P.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hashpartitioning") <= most  # before, two of all entries and, for the export, one more of pages


def test_alike_rows_give_their_first_and_last(spark):
    rnd = random.Random(3)
    rows = [row(rnd.choice([None, *range(400)]), rnd.choice(["artist", "", None]), rnd.choice(["a", "img[href]", None]), rnd.choice(["title", "hero_image", "avatar", None]), rnd.randrange(2), is_required=rnd.random() < 0.3, is_enabled=rnd.random() < 0.9) for _ in range(1500)]
    df = spark.createDataFrame(rows, ROW)
    few = P.outermost(df)
    alike = {(*r[:1], *r[2:], r[1] is None) for r in rows if r[NAMES.index("is_enabled")]}
    assert len(alike) <= few.count() <= 2 * len(alike) < len(rows) / 2
    assert "Sort" not in few._jdf.queryExecution().executedPlan().toString()  # on numbers: no sort of all rows
    assert sorted(map(str, P.page_rules(P.row_entries(few)).collect())) == sorted(map(str, P.page_rules(P.row_entries(df)).collect()))


def test_runtime_extract_parses_pages_once_and_its_rules_once(spark, sf_dir):
    plan = P.QUERIES["runtime_extract"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "lineitem" not in plan  # before, both were in it twice


def test_nodes_keep_texts_of_their_page(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (2, "<i>c</i>", None), (3, None, "y")], "page_id long, html string, kind string")
    got = page_nodes(pages, keep=("kind",))
    want = page_nodes(pages).join(pages.select("page_id", "kind"), "page_id")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 4
