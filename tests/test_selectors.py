"""Selectors against a plain matcher, and the extractions on literal pages."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomscan.functions import html as H
from loomscan.functions.html import Nodes, page_nodes
from loomscan.operators import selectors as X

PAGE = """<html><head><title> T </title><meta name="description" content="About it"></head><body><nav id="menu"><ul><li class="a first"><a href="/one#x">One</a></li><li class="a"><a href="https://b.com/two">Two</a></li>
<li class="b" lang="en-GB"><a href="javascript:go()">Go</a><a href="three">Three</a></li></ul></nav><div class="ad box"><p>Buy</p></div><main><article><h1>Head <i>line</i></h1><p>First</p><p>Second <b>bold</b></p><div><p>Deep</p></div></article></main></body></html>"""


def tree(html):
    p = Nodes()
    p.feed(html)
    p.close()
    return p.rows


def fits(row, step):
    _, _, _, _, _, tag, ident, classes, attrs, nth = step
    at = {"place": row["place"], "from_end": row["siblings"] - row["place"] + 1, "of_type": row["of_type"], "of_type_from_end": row["alike"] - row["of_type"] + 1}
    test = {"": lambda v, w: True, "=": lambda v, w: v == w, "~=": lambda v, w: w != "" and w in v.split(), "|=": lambda v, w: v == w or v.startswith(w + "-"), "^=": lambda v, w: w != "" and v.startswith(w), "$=": lambda v, w: w != "" and v.endswith(w), "*=": lambda v, w: w != "" and w in v}
    return tag in ("*", row["tag"]) and (ident is None or row["element_id"] == ident) and set(classes) <= set(row["classes"]) and all(k in row["attrs"] and test[o](row["attrs"][k], v) for k, o, v in attrs) and all(any(at[w] == a * k + b for k in range(60)) for w, a, b in nth)


def plain(rows, selector):
    found = set()
    steps = X.compiled(selector) or []
    for alt in {s[0] for s in steps}:
        chain = [s for s in steps if s[0] == alt]

        def holds(row, k, chain=chain):
            if row["tag"] == "#text" or not fits(row, chain[k]):
                return False
            if k == 0:
                return True
            how, above = chain[k][3], row["parent"]
            if how == ">":
                return above is not None and holds(rows[above], k - 1)
            if how == " ":
                while above is not None:
                    if holds(rows[above], k - 1):
                        return True
                    above = rows[above]["parent"]
                return False
            before = [r for r in rows if r["tag"] != "#text" and r["parent"] == row["parent"] and r["place"] < row["place"]]
            return any(holds(r, k - 1) for r in before if how == "~" or r["place"] == row["place"] - 1)

        found |= {r["node"] for r in rows if holds(r, len(chain) - 1)}
    return found


def selected(spark, pages, rules):
    nodes = page_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    return {(r["rule"], r["page_id"], r["node"]) for r in X.select_nodes(nodes, spark.createDataFrame(list(enumerate(rules)), "rule int, selector string")).collect()}


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li", 3), ("ul > li", 3), ("nav li a", 4), ("body > a", 0), ("li + li", 2), ("li.first ~ li", 2), ("li.a.first", 1), (".a", 2), ("#menu a[href]", 4), ("a[href^='/']", 1), ("a[href$=two]", 1), ("a[href*='b.com']", 1),
        ("li[lang|=en]", 1), ("div[class~=box]", 1), ("li:first-child", 1), ("li:last-child > a:nth-child(2)", 1), ("article p:nth-of-type(2)", 1), ("article > p", 2), ("article p", 3), ("h1, title", 2), ("li:nth-child(odd)", 2), ("*.ad *", 1), ("main p b, nav i", 1), ("p:hover", 0), ("a >", 0), ("", 0),
    ],
)
def test_each_combinator(spark, selector, want):
    got = selected(spark, [(1, PAGE)], [selector])
    assert {n for _, _, n in got} == plain(tree(PAGE), selector) and len(got) == want


def test_random_pages_and_selectors(spark):
    rnd = random.Random(3)

    def html(depth=0):
        return "".join(f"<{(t := rnd.choice(['div', 'span', 'ul', 'b']))} class='{rnd.choice(['x', 'y', 'x y', ''])}' {rnd.choice(['', 'k=v', 'id=i'])}>{html(depth + 1) if depth < 5 else 'text'}</{t}>" for _ in range(rnd.randint(0, 3)))

    part = lambda: rnd.choice(["div", "span", "*", "b", ""]) + rnd.choice([".x", ".y", ".x.y", "[k]", "[k=v]", ":first-child", ":nth-of-type(2n)", "#i", ".x:last-child"])
    rules = ["".join(part() + rnd.choice([" ", " > ", " + ", " ~ ", ", "]) for _ in range(rnd.randint(0, 3))) + part() for _ in range(40)]
    pages = [(i, html()) for i in range(12)]
    assert selected(spark, pages, rules) == {(k, i, n) for k, s in enumerate(rules) for i, h in pages for n in plain(tree(h), s)}


def page(spark, html=PAGE, kind="unknown", url="http://a.com/x/y"):
    df = spark.createDataFrame([(1, url, html, kind, 0)], "page_id long, url string, html string, page_type string, depth int")
    return df, page_nodes(df)


def test_fields(spark):
    pages, nodes = page(spark, PAGE + "<a class='m' href='MAILTO:Jo@b.co?x=1'>write</a><img class='pic' data-src='p.png'>")
    rules = [("title", "h1"), ("items", "article > p"), ("site_link", "li.first a"), ("email", "a.m"), ("photo", ".pic"), ("gone", "h6"), ("bad", "p:hover")]
    got = X.selector_extract(pages, nodes, spark.createDataFrame(rules, "field string, selector string"), (("word", "sec(on)d"), ("year", "[0-9]{4}"))).first()
    assert json.loads(got["data"]) == {"title": "Head line", "items": ["First", "Second bold"], "site_link": "http://a.com/one", "email": "jo@b.co", "photo": "http://a.com/x/p.png", "word": "on"} and got["confidence"] == 70


def test_follow_and_assets(spark):
    pages, nodes = page(spark)
    follow = lambda rules, at=0, seen=None: {r["target"] for r in X.follow_links(pages.withColumn("depth", F.lit(at)), nodes, spark.createDataFrame(rules, "page_type string, selector string, max_depth int"), seen).collect()}
    assert follow([("unknown", "li a", 2)], 1) == {"http://a.com/one", "http://a.com/x/three"} == follow([("other", "li", 9)])
    assert follow([("unknown", "li a", 2)], 2) == set() and follow([("unknown", "li a", 1)], 0, spark.createDataFrame([("http://a.com/one",)], "target string")) == {"http://a.com/x/three"}
    pages, nodes = page(spark, "<img src='data:xx' data-src='/a.png#f'><img src=b.png><a href='c.pdf'>c</a>")
    got = X.asset_urls(pages, nodes, spark.createDataFrame([("unknown", "img, a")], "page_type string, selector string"))
    assert {r["asset"] for r in got.collect()} == {"http://a.com/a.png", "http://a.com/x/b.png", "http://a.com/x/c.pdf"}


def test_related_items(spark):
    html = "<ul><li>Short</li><li>Big solo show, Paris, 2001 to 2004</li><li>In <b>The <i>Whole</i> Title</b> of 3 May 1999 <a>x</a><a href='/r'>read</a></li></ul>"
    got = sorted((r.asDict() for r in X.related_items(*page(spark, html, "artist_exhibitions")).collect()), key=lambda r: r["node"])
    assert [(r["title"], r["date_text"], r["year_start"], r["year_end"], r["solo_or_group"], r["kind"]) for r in got] == [("Big solo show", "2001 - 2004", 2001, 2004, "solo", "exhibition"), ("The Whole Title", "3 May 1999", 1999, 1999, None, "exhibition")]
    got = sorted((r.asDict() for r in X.related_items(*page(spark, html, "artist_press")).collect()), key=lambda r: r["node"])
    assert [(r["title"], r["publication_date"], r["link"]) for r in got] == [("Big solo show, Paris, 2001 to 2004", "2001-01-01", None), ("The Whole Title", "1999-01-01", "http://a.com/r")]
    assert X.related_items(*page(spark, html)).count() == 0


def test_images(spark):
    html = "<div>Artist <b>photo</b><img src='a.jpg' alt=''><img src='a.jpg'></div><img src='i.svg'><img src='t.jpg' width=50px height='200'><img src='w.jpg' width=50><img src='https://www.facebook.com/p.jpg'><img src='data:x' data-src='lazy.jpg' class='Portrait'>"
    got = {r["src"].removeprefix("http://a.com/x/"): (r["role"], r["context"], r["occurrences"], r["width"]) for r in X.extract_images(*page(spark, html)).collect()}
    assert got == {"a.jpg": ("artist_photo", "Artistphoto", 2, None), "w.jpg": ("unknown", "", 1, 50), "lazy.jpg": ("profile", "", 1, None)}


def test_selector_candidates(spark):
    nodes = page_nodes(spark.createDataFrame([(1, "<h1 class='t big'>A long title</h1><p>other words</p>"), (2, "<h1 class='t'>Some title hete</h1><div class='t'>Some title here</div>"), (3, "<p></p>")], "page_id long, html string"))
    want = spark.createDataFrame([(1, "title", "a long title!"), (2, "title", "Some title here"), (3, "title", "x")], "page_id long, field string, expected string")
    got = {r["selector"]: (r["confidence"], r["strategy"], r["hits"]) for r in X.selector_candidates(nodes, want, {"title": "main > h1.t.old"}).collect()}
    assert got == {
        "h1": (round(0.5 + 0.2 * 2 / 3, 6), "tag_frequency", 2), "div": (round(0.5 + 0.2 / 3, 6), "tag_frequency", 1), ".t": (0.8, "class_frequency", 3), ".big": (round(0.55 + 0.25 / 3, 6), "class_frequency", 1),
        "h1.t.old": (0.65, "relax_existing_selector", None), "main > h1": (0.65, "relax_existing_selector", None), "[data-field*='title'], .title, [class*='title']": (0.45, "field_name_fallback", None),
    }


def test_preview(spark):
    assert X.html_preview(page(spark)[1]).first()["preview"] == "T\nAbout it\nBuy\nHead line\nFirst\nSecond bold\nDeep"


def test_registered_queries_give_rows(spark):
    for name, query in X.QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name


def test_related_items_parses_pages_once(spark, sf_dir):
    plan = X.QUERIES["related_items"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the written nodes are read; before, each reader parsed all pages


def test_a_parser_gets_few_pages_at_a_time(spark, monkeypatch):
    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32())], names=["n"])

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.range(0, 3 * H.BATCH_PAGES, 1, 1).selectExpr("id as page_id", "concat('<p>', id) as html")
    old = spark.conf.get(limit)
    assert pages.join(H.written_nodes(pages).where("tag = 'p'"), "page_id").count() == 3 * H.BATCH_PAGES
    monkeypatch.setattr(H, "page_nodes", lambda pages, keep=(): pages.mapInArrow(sizes, "n int"))
    assert [r["n"] for r in H.written_nodes(pages).collect()] == [H.BATCH_PAGES] * 3
    assert spark.conf.get(limit) == old


@pytest.mark.parametrize("name", ["selector_extract", "backfill_extract", "html_preview", "selector_candidates", "follow_links", "extract_images", "asset_urls"])
def test_pages_are_parsed_once(spark, sf_dir, name):
    assert "MapInArrow" not in X.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()  # before, once a reader and from batches of 10,000 pages


def test_image_addresses_are_resolved_once(spark, sf_dir):
    df = X.QUERIES["extract_images"](spark, sf_dir)
    scans = set(re.findall(r"images-[0-9a-f]{32}", "".join(df.inputFiles())))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(scans) == 1 and "Generate explode" not in plan  # before, both readers of the images unfolded and resolved them
