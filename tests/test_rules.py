"""Literal cases of the rules that are easy to get wrong."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.functions import urls as U
from loomscan.functions.gestalt import reaches, sequence_ratio
from loomscan.functions.html import page_nodes
from loomscan.operators import drift, entities, listing, pages, ranking, reports, sets
from loomscan.sources import tables


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://A.com:80/x/?b=2&a=1#t", "http://a.com/x?a=1&b=2"), ("a.com", "https://a.com/"), ("https://a.com:443/", "https://a.com/"), ("http://a.com:8080/p?x=", "http://a.com:8080/p?x=")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.col("u")), u=url) == want


def test_path_pattern(spark):
    assert one(spark, U.path_pattern(F.lit("http://a.com/artists/12/deadbeef00/jane2"))) == "/artists/{num}/{hex}/{slug}"
    assert one(spark, U.family_key(F.lit("http://A.com/Jane/works"))) == "a.com::jane"
    assert one(spark, U.family_key(F.lit("http://a.com/x.php"))) is None


def test_policy_times(spark):
    now = dt.datetime(2024, 1, 1)
    due = {p: one(spark, S.next_eligible(F.lit(p), F.lit(now))) for p in ("realtime", "daily", "weekly", "monthly", "manual", "odd")}
    assert due["realtime"] - now == dt.timedelta(minutes=5) and due["weekly"] - now == dt.timedelta(days=7) and due["monthly"] - now == dt.timedelta(days=30)
    assert due["manual"] is None and due["odd"] == due["daily"]


def test_content_change(spark):
    c = lambda *v: one(spark, S.content_change(*[F.lit(x).cast("string") for x in v]))
    assert c("a", "b", "e", "e", None, None) == "hash"
    assert c("a", "a", "e", "f", None, None) == "unchanged"
    assert c(None, "b", "e", "f", None, None) == "etag"
    assert c(None, "b", None, "f", "m", "n") == "last_modified"


def test_frontier_order_is_priority_depth_age(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "s", 5, 0, "queued", None, None, t), (2, "s", 80, 1, "queued", None, None, t), (3, "s", 80, 0, "queued", None, None, t)]
    df = spark.createDataFrame(rows, "id int, source_id string, priority int, depth int, status string, next_retry_at timestamp, next_eligible_at timestamp, created_at timestamp")
    got = ranking.frontier_due(df, "timestamp '2024-01-02'", 3).orderBy("place").collect()
    assert [r["id"] for r in got] == [3, 2, 1]


def test_family_drift_gives_its_three_signals(spark):
    rows = [("f", "skipped", "selector_miss" if i < 6 else None, "changed" if i < 7 else "unchanged") for i in range(10)]
    df = spark.createDataFrame(rows, "family string, status string, skip_reason string, last_refresh_outcome string")
    got = {r["signal"]: r["severity"] for r in drift.family_drift(drift.family_ratios(df, ["family"]), ["family"]).collect()}
    assert got == {"null_rate_spike": "high", "refresh_change_spike": "high", "unexpected_skip_spike": "high"}


def test_edges_built_twice_leave_one_edge(spark):
    df = spark.createDataFrame([(1, 2, 1, 0.5), (1, 2, 2, 0.6)], "a int, b int, o int, confidence double")
    r = entities.noisy_or(df, ["a", "b"], "o").first()
    assert r["signals"] == 2 and r["confidence"] == pytest.approx(1 - 0.5 * (1 - 0.85 * 0.6))


def test_clusters_are_a_partition(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 8), (20, 3)], "a int, b int")
    got = {r["id"]: r["cluster"] for r in entities.clusters(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def test_string_ratio_and_its_bound(spark):
    rows = [("alex brown", "alex browne"), ("a", "a" * 50), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(sequence_ratio(F.col("a"), F.col("b")).alias("r"), reaches(F.col("a"), F.col("b"), 0.7).alias("k")).collect()
    assert got[0]["r"] == pytest.approx(0.952, abs=1e-3) and got[0]["k"] and not got[1]["k"] and got[2]["r"] == 0.0 == got[3]["r"]


def test_signals_coalesce_by_gap(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "s", t, "low", "open"), (2, "s", t + dt.timedelta(hours=11), "high", "open"), (3, "s", t + dt.timedelta(hours=22), "low", "resolved"), (4, "s", t + dt.timedelta(hours=24), "low", "open")]
    df = spark.createDataFrame(rows, "id int, k string, detected_at timestamp, severity string, status string")
    got = sorted((r["occurrences"], r["severity"]) for r in drift.coalesce_signals(df, ["k"]).collect())
    assert got == [(1, "low"), (2, "high")]


def test_html_nodes_of_unclosed_tags(spark):
    html = "<div class='a b'><p><b>one<p>two</div><img data-src='x.png'>"
    got = [r for r in page_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("node").collect()]
    assert [r["tag"] for r in got] == ["div", "p", "b", "#text", "p", "#text", "img"] and got[0]["classes"] == ["a", "b"] and got[6]["attrs"] == {"data-src": "x.png"}
    assert [r["last"] for r in got] == [5, 5, 5, 3, 5, 5, 6] and [r["parent"] for r in got] == [None, 0, 1, 2, 2, 4, None]


def test_html_text_after_the_last_tag_stays(spark):
    got = page_nodes(spark.createDataFrame([(1, "<p>hello AT&T"), (2, "<script>var a = '<p>';</script>x &eacute; &lt;")], "page_id long, html string")).where("tag = '#text'").collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(1, "hello AT&T"), (2, "x é <")}


def test_insert_if_absent_keeps_existing_rows(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, sets.insert_if_absent(old, new, ["k"], "v").collect())) == [("a", 1), ("b", 2)]


def test_wildcards_in_a_search_stay(spark):
    df = spark.createDataFrame([(1, "cat"), (2, "cut"), (3, None)], "id int, title string")
    assert [r["id"] for r in listing.list_records(df, search="c_t").collect()] == [1, 2]


def test_days_without_rows_are_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "ts timestamp")
    assert [r["n"] for r in reports.daily(df, "ts", "2024-01-01", "2024-01-03", n=F.count("*")).orderBy("day").collect()] == [0, 1, 0]


def test_empty_embedding_and_unequal_lengths(spark):
    assert one(spark, S.hash_embedding(F.lit(""))) == [0.0] * 96
    assert one(spark, S.cosine_similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_merge_candidates_are_all_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist(), str(i % 7)) for i, v in enumerate(x)], "id long, embedding array<float>, label string")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if round(float(unit[i] @ unit[j]), 5) >= 0.3}
    got = [(r["l_id"], r["r_id"]) for r in entities.merge_candidates(df, 0.3, block=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_merge_candidates_deal_a_row_to_few_blocks(spark):
    dealt = entities._blocks(spark.range(200_000)).groupBy("id").count().agg({"count": "max"}).first()[0]
    assert dealt <= 40  # one to each block of 1,024 rows before, 196
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, None]), (6, None)], "id long, embedding array<double>")
    assert [tuple(r) for r in entities.merge_candidates(df, 0.3).collect()] == [(1, 2, 0.6)]


@pytest.mark.parametrize("least", [0.6, 0.45])
def test_duplicate_candidates_are_all_pairs_at_the_score(spark, least):
    rng = np.random.default_rng(8)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = []
    for i in range(60):
        name = " ".join(rng.choice(["red", "blue", "tin", "box", "cup-red"], 3)) if i % 9 else ""
        rows.append((i, name, pick("w1", "w2", "w3", None, ""), pick(1, 2, 3), None if i % 7 == 3 else rng.normal(size=3).tolist(), [pick("a", "b")], [pick("a", "b"), "c"], []))
    df = spark.createDataFrame(rows, "id long, name string, website_url string, birth_year int, embedding array<double>, exhibitions array<string>, articles array<string>, press array<string>")

    def score(a, b):
        x, y = (set(r[1].replace("-", " ").split()) for r in (a, b))
        u, v = (np.array(r[4]) if r[4] else np.zeros(3) for r in (a, b))
        near = float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v))) if u.any() and v.any() else 0.0
        over = sum(len(set(p) & set(q)) / len(set(p) | set(q)) for p, q in zip(a[5:], b[5:], strict=True) if p and q) / 3
        return 0.35 * (len(x & y) / len(x | y) if x and y else 0.0) + 0.4 * near + 0.15 * bool(a[2] and a[2] == b[2]) + 0.1 * over

    want = {(a[0], b[0]): score(a, b) for a in rows for b in rows if a[0] < b[0] and score(a, b) >= least}
    got = entities.duplicate_candidates(df, least).collect()
    assert len(got) == len(want) and {(r["l_id"], r["r_id"]): pytest.approx(r["score"], abs=1e-4) for r in got} == want and want
    assert all(r["auto_merge"] == (r["score"] >= 0.85 and any(rows[r["l_id"]][k] and rows[r["l_id"]][k] == rows[r["r_id"]][k] for k in (2, 3))) for r in got)


def test_like_word_sets_are_all_at_the_overlap(spark):
    rng = np.random.default_rng(4)
    sets = sorted({tuple(sorted(set(rng.choice(list("abcdefgh"), rng.integers(1, 6))))) for _ in range(60)})
    df = spark.createDataFrame([(list(x),) for x in sets] + [([],)], "words array<string>")
    for least in (0.2, 0.5, 1.0):
        want = {(a, b) for a in sets for b in sets if len(set(a) & set(b)) / len(set(a) | set(b)) >= least}
        got = [(tuple(r["a"]), tuple(r["b"])) for r in entities._like_sets(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_duplicate_candidates_with_and_without_vectors(spark):
    rows = [(1, "a b", "x", [1.0, 0.0]), (2, "c", "y", [1.0, 0.0]), (3, "b a", "x", None), (4, "a b", "z", [1.0]), (5, "a b", "z", None), (6, "q", "x", None)]
    df = spark.createDataFrame([(*r, ["e"], ["e"], ["e"]) for r in rows], "id long, name string, website_url string, embedding array<double>, exhibitions array<string>, articles array<string>, press array<string>")
    got = {(r["l_id"], r["r_id"]): r["score"] for r in entities.duplicate_candidates(df, 0.45).collect()}
    assert got == {(1, 2): 0.5, (1, 3): 0.6, (1, 4): 0.45, (1, 5): 0.45, (3, 4): 0.45, (3, 5): 0.45, (4, 5): 0.6}


def test_duplicate_candidates_score_rows_alike_once(spark, monkeypatch):
    kinds = [("a b", "x", None), ("b a", "x", [1.0, 0.0]), ("a b", "x", [1.0]), ("a c", "x", None), ("q", "y", None), ("a b", None, None)]
    rows = [(i, *kinds[i * 7 % 6], i % 3, ["e"], ["e"], []) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, website_url string, embedding array<double>, birth_year int, exhibitions array<string>, articles array<string>, press array<string>")
    of, seen = entities._scored_without_vectors, []
    monkeypatch.setattr(entities, "_scored_without_vectors", lambda df, least: (seen.append(df.count()), of(df, least))[1])

    def score(a, b):
        x, y = set(a[1].split()), set(b[1].split())
        near = 1.0 if a[3] and a[3] == b[3] else 0.0
        return 0.35 * len(x & y) / len(x | y) + 0.4 * near + 0.15 * bool(a[2] and a[2] == b[2]) + 0.1 * 2 / 3

    want = {(a[0], b[0]): (pytest.approx(s, abs=1e-4), s >= 0.85 and a[2] == b[2]) for a in rows for b in rows if a[0] < b[0] and (s := score(a, b)) >= 0.45}
    got = entities.duplicate_candidates(df, 0.45).collect()
    assert len(got) == len(want) and {(r["l_id"], r["r_id"]): (r["score"], r["auto_merge"]) for r in got} == want
    assert seen == [6]  # 120 before


@pytest.mark.parametrize(("href", "want"), [("one", "http://a.com/x/one"), ("/two", "http://a.com/two"), ("../three", "http://a.com/three"), ("./four/../five?q=1#f", "http://a.com/x/five?q=1"), ("//a.com/six", "http://a.com/six"), ("?p=2", "http://a.com/x/y.html?p=2"), ("#top", None), ("", None), ("mailto:a@b.co", None), ("javascript:go()", None), ("HTTPS://a.com/s", "HTTPS://a.com/s"), ("..", "http://a.com/"), ("../../../up", "http://a.com/up"), ("http://b.com/z", "http://b.com/z")])
def test_links_resolve_like_a_browser(spark, href, want):
    assert one(spark, U.resolve(F.lit("http://a.com/x/y.html"), F.col("h")), h=href) == want
    if want and href[:2] != "//":
        from urllib.parse import urldefrag, urljoin

        assert want.lower() == urldefrag(urljoin("http://a.com/x/y.html", href)).url.lower()


def test_links_of_a_page(spark):
    html = """<a href='one'>1</a><A class="k" HREF="/two">2</A><a data-href="no" href=four>4</a><a href="//a.com/five?a=1&amp;b=2">5</a><!-- <a href="/no"> --><script>"<a href='/no'>"</script><a href="http://b.com/x">b</a><a name=x>n</a>"""
    df = spark.createDataFrame([(1, "http://a.com/x/y.html", "a.com", html)], "id int, url string, source_id string, html string")
    assert [r["target"] for r in pages.extract_links(df).orderBy("pos").collect()] == ["http://a.com/x/one", "http://a.com/two", "http://a.com/x/four", "http://a.com/five?a=1&b=2"]


@pytest.mark.parametrize(("url", "want"), [("https://a.com/artists/about", 80), ("https://a.com/about", 5), ("https://a.com/cookie-policy", 5), ("https://a.com/gallery", 30), ("https://a.com/x/event-2", 80), ("https://a.com/", 30)])
def test_url_priority(spark, url, want):
    assert one(spark, U.score_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.com/artists/B", "artist_directory_letter"), ("https://a.com/jane/about.php", "artist_biography"), ("https://a.com/jane/press-reviews.php", "artist_press"), ("https://a.com/artist/jane-doe/", "artist_profile"), ("https://a.com/artists", "artist_directory"), ("https://a.com/whats-on", "event_listing"), ("https://a.com/shows/summer", "exhibition_detail"), ("https://a.com/shop", "artwork_listing"), ("https://a.com/artworks/7?x=1", "artwork_detail"), ("https://a.com/x", None)])
def test_url_page_types(spark, url, want):
    assert one(spark, U.url_page_type(F.col("u")), u=url) == want


def test_page_classes_in_order(spark):
    hub = "".join(f"<a href='/x'> {x.title()} </a>" for x in pages.HUB_LABELS)
    rows = [(1, "http://a.com/artists", '<script type="application/ld+json">{"@type": "ArtGallery"}</script>'), (2, "http://a.com/artists", '{"@type": "Thing"}'), (3, "http://a.com/q", hub), (4, "http://a.com/q", "Artist names starting with B"), (5, "http://a.com/q", "")]
    got = {r["id"]: (r["page_type"], r["confidence"]) for r in pages.classify(spark.createDataFrame(rows, "id int, url string, html string")).collect()}
    assert got == {1: ("venue_profile", 95), 2: ("artist_directory", 75), 3: ("artist_profile_hub", 80), 4: ("artist_directory_letter", 80), 5: ("unknown", 0)}


def test_scores_and_types(spark):
    yes, no = F.lit(True), F.lit(False)
    score, missing = S.artist_completeness(yes, yes, no, yes, no, yes, yes)
    assert one(spark, score) == 65 and one(spark, missing) == "website_or_email,exhibitions_articles_press"
    score, band, reasons = S.confidence_score(F.lit("artist"), yes, yes, yes, no, yes, yes, no, F.lit(80))
    assert one(spark, score) == 65 and one(spark, band) == "MEDIUM" and one(spark, reasons) == "title present,description present,artists linked,avatar image found,high AI confidence"
    assert one(spark, S.normalize_record_type(F.lit(" Artist_Press "))) == "artwork" and one(spark, S.normalize_record_type(F.lit("painter"))) is None
    score, missing, critical = S.typed_completeness(F.lit("venue"), {"title": F.lit("x"), "city": F.lit(" "), "country": F.lit("[]")})
    assert one(spark, score) == 11 and one(spark, critical) == "source_url" and one(spark, missing).startswith("source_url,address,city,country")


def test_image_roles_in_order(spark):
    role = lambda *v: tuple(one(spark, S.image_role(*[F.lit(x) for x in v])))
    assert role("/a.jpg", "Portrait of A", "", "", 1) == ("profile", 88, "keyword_profile")
    assert role("/a.jpg", "", "photo of the artist", "nav", 1) == ("artist_photo", 78, "context_artist_photo")
    assert role("/a.jpg", "", "", "sidebar", 1) == ("template_shared", 74, "dom_zone_template")
    assert role("/logo.png", "", "", "", 1) == ("decorative", 70, "decorative_context")
    assert role("/a.jpg", "", "", "", 2) == ("template_shared", 68, "repeated_across_page") and role("/a.jpg", None, None, None, 1)[0] == "unknown"


def test_hints_are_no_patterns(spark):
    df = spark.createDataFrame([(1, "http://a.com/a+b"), (2, "http://a.com/aab"), (3, "http://a.com/blogs")], "id int, url string")
    assert [r["id"] for r in listing.url_ignore(df, ["a+b", "blog."]).collect()] == [2, 3]


def test_selector_rates(spark):
    df = spark.createDataFrame([(1, x) for x in ["A One", "a one", "Two", "read more", None]] + [(2, None)], "k int, value string")
    got = {r["k"]: r.asDict() for r in drift.validate(df, ["k"], "title").collect()}
    assert got[1] == {"k": 1, "success": 0.8, "plausible": 0.6, "diversity": 0.75, "consistency": 0.5, "pattern": 1.0, "nonsense": 0.25, "validated": False}
    assert (got[2]["success"], got[2]["diversity"], got[2]["consistency"], got[2]["nonsense"]) == (0.0, 0.0, 0.0, 1.0)


def test_template_weights(spark):
    items = spark.createDataFrame([(1, "k", "s", ["a"], "x/y"), (2, "k", "z", ["a", "b"], "x"), (3, "q", "s", ["a", "b"], "x")], "id int, kind string, system string, words array<string>, patterns string")
    templates = spark.createDataFrame([(0, "k", "s", ["a", "b"], ["X"]), (1, "k", "s", ["a", "b"], ["x"])], "template int, t_kind string, t_system string, t_words array<string>, t_tokens array<string>")
    assert {r["id"]: (r["template"], r["score"]) for r in ranking.template_match(items, templates).collect()} == {1: (0, 0.875), 2: (0, 0.75)}


def test_signals_are_folded_by_partial_aggregates(spark):
    groups = {1: [0.3, 0.2, 0.9, 0.1], 2: [0.5], 3: [0.2, 1.3, 0.4], 4: [1.2, 0.4], 5: [0.4, -0.5, 0.2], 6: [0.4, None], 7: [None, 0.3], 8: [1.0, 0.2], 9: [0.0] * 40 + [0.01] * 40}
    df = spark.createDataFrame([(k, i, c) for k, v in groups.items() for i, c in enumerate(v)], "k int, o int, confidence double")

    def fold(v):
        e = v[0]
        for x in v[1:]:
            e = 1.0 if e is None or x is None else max(e, min(1.0, 1 - (1 - e) * (1 - 0.85 * x)))
        return e

    want = {k: (pytest.approx(fold(v), abs=1e-6), len(v)) for k, v in groups.items()}
    for few in (1000, 3, 1):
        assert {r["k"]: (r["confidence"], r["signals"]) for r in entities.noisy_or(df, ["k"], "o", fold=few).collect()} == want


def test_signals_beyond_a_million_count(spark):
    df = spark.range(1_000_005).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("o"), F.when(F.col("id") == 1_000_004, 0.5).otherwise(0.0).alias("confidence"))
    assert [tuple(r) for r in entities.noisy_or(df, ["k"], "o").collect()] == [(None, pytest.approx(0.425), 1_000_005)]


def test_field_drift_gives_each_signal_once(spark):
    rows = [(1, "title", "text", "abc", None, None, None), (2, "title", "text", "abc", "  ", None, None), (3, "title", "text", "abcd", "abcdefgh", None, None), (4, "title", "text", "abcd", "abcdef", None, None), (5, "title", "text", "abc", "ab1", None, None),
            (6, "title", "text", "abc", "abd", None, None), (7, "year", "number", "5", "9", 5.0, 1.0), (8, "year", "number", "5", "7", 5.0, 1.0), (9, "start_date", "date", "2024-01-31", "2024-02-01", None, None), (10, "title", "text", None, "abc", None, None), (11, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, field string, kind string, previous string, current string, mean double, sd double")
    got = {r["id"]: (r["signal"], r["severity"], r["confidence"]) for r in drift.field_drift(df).collect()}
    assert got == {
        1: ("field_missing", "high", 0.95), 2: ("field_empty", "high", 0.95), 3: ("value_anomaly", "medium", 0.7), 4: ("value_anomaly", "low", 0.7), 5: ("value_anomaly", "low", 0.65),
        7: ("value_anomaly", "medium", 0.8), 9: ("value_anomaly", "low", 0.6),
    }


def test_page_drift_needs_both_hashes_and_a_fall_of_25(spark):
    rows = [(1, "Selector .x failed", "a", "a", 50, 50), (2, None, "a", "b", 50, 26), (3, None, None, "b", 50, 25), (4, None, "a", "", 10, None), (5, None, "a", "a", 30, None)]
    df = spark.createDataFrame(rows, "id long, error string, old_hash string, new_hash string, old_confidence int, new_confidence int")
    assert sorted((r["id"], r["signal"]) for r in drift.page_drift(df).collect()) == [(1, "selector_fail"), (2, "structure_changed"), (3, "confidence_drop"), (5, "confidence_drop")]


def test_review_queues_take_pending_rows_and_limit_each_queue(spark):
    records = spark.createDataFrame([(1, "a", "pending", True, 30, "2024-01-01"), (2, "b", "approved", True, 10, "2024-01-03"), (3, "c", "pending", False, None, "2024-01-02")], "id long, title string, status string, has_conflicts boolean, completeness_score int, updated_at string")
    reviews = spark.createDataFrame([(7, 1, 9, 80, "pending"), (8, 1, 2, 90, "decided")], "id long, left_id long, right_id long, score int, status string")
    got = sorted((r["queue"], r["id"], r["priority"]) for r in listing.review_queue(records, reviews).collect())
    assert got == [("completeness", 1, 70), ("completeness", 3, 100), ("conflicts", 1, 70), ("duplicates", 7, 80), ("recent", 1, 1), ("recent", 2, 1), ("recent", 3, 1)]
    one = {r["queue"]: (r["id"], r["left_title"], r["right_title"]) for r in listing.review_queue(records, reviews, 1).collect()}
    assert one == {"completeness": (3, "c", None), "conflicts": (1, "a", None), "duplicates": (7, "a", None), "recent": (2, "b", None)}


def test_frontier_upsert_keeps_the_row_and_refreshes_family_and_due_time(spark):
    kind = "id long, source_id long, url string, priority int, depth int, family_key string, next_eligible_at string"
    stored = spark.createDataFrame([(1, 1, "u", 50, 2, "f", None)], kind)
    found = spark.createDataFrame([(2, 1, "u", 80, 0, "g", "d1"), (3, 1, "u", 10, 1, "", "d2"), (4, 1, "v", 5, 3, None, None), (5, 1, "v", 7, 1, "h", None)], kind)
    assert sorted(map(tuple, sets.frontier_upsert(stored, found).collect())) == [(1, "u", 80, 2, "g", "d2"), (1, "v", 7, 3, "h", None)]


def test_build_edges_of_each_kind(spark):
    kind = "id long, record_type string, title string, artist_names array<string>, venue_name string, confidence_score int"
    rows = [(1, "artist", " Ann ", None, None, 90), (2, "artwork", "w", ["ANN", "Nobody"], None, 80), (3, "exhibition", "x", ["ann", "Ann"], "Hall", 20), (4, "event", "e", None, "hall ", None), (5, "venue", "Hall", None, None, 70), (6, "artwork", "unlinked", ["Ann"], None, 90), (7, None, None, None, None, None)]
    links = spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4, 5, 7)], "record_id long, entity_id long")
    named = spark.createDataFrame([("artist", "ann", 10), ("venue", "hall", 50)], "entity_type string, name string, entity_id long")
    got = sorted(tuple(r) for r in entities.build_edges(spark.createDataFrame(rows, kind), links, named).collect())
    assert got == [(10, 30, "PARTICIPATED_IN", 0.5, 1), (20, 10, "CREATED_BY", 0.8, 1), (30, 50, "EXHIBITED_AT", 0.5, 1), (50, 40, "HOSTED_EVENT", 0.5, 1)]


def test_log_rows_of_odd_payloads(spark):
    rows = [(1, '{"event": "go", "level": "ERROR", "timestamp": "2024-01-02T03:04:05Z", "source_id": "s", "k": 1}'), (2, '{"level": "critical", "timestamp": "soon"}'), (3, "no json"), (4, None)]
    df = tables.normalize_logs(spark.createDataFrame(rows, "id long, payload string"), "miner", F.expr("timestamp '2024-03-01 00:00:00'"), "warning")
    got = [(r["id"], str(r["timestamp"]), r["level"], r["source_id"], r["message"], r["context"]) for r in df.orderBy("id").collect()]
    late = "2024-03-01 00:00:00"
    assert got == [(1, "2024-01-02 03:04:05", "error", "s", "go", '{"k":"1"}'), (2, late, "info", None, "", None), (3, late, "warning", None, "", None), (4, late, "warning", None, "", None)]


def test_reports_of_empty_tables_are_zero(spark):
    jobs = spark.createDataFrame([], "id long, source_id long, status string, created_at timestamp")
    sources = spark.createDataFrame([], "enabled boolean, queue_paused boolean")
    assert tuple(reports.queue_summary(jobs, sources, "timestamp '2024-01-01 00:00:00'").first()) == (0, 0, 0, 0, 0)
    assert reports.source_operations(jobs, spark.createDataFrame([], "source_id long")).count() == 0
