"""URL rules on literal pages, and against a loop over all rules."""

import re

import pytest

from loomscan.operators import patterns as P


def classify(spark, path, *rules):
    pages = spark.createDataFrame([(1, "s", path), (2, "other", path)], "id int, source_id string, path string")
    rows = [("s", k, *r) for k, r in enumerate(rules)]
    return {r["id"]: r["page_type"] for r in P.rule_classify(pages, spark.createDataFrame(rows, "source_id string, rule int, kind string, page_type string, pattern string")).collect()}


@pytest.mark.parametrize(
    ("path", "rules", "want"),
    [
        ("/artists/jane-doe", [("identifier", "list", "/artists"), ("identifier", "artist", "/artists/[name]")], "artist"), ("/artists", [("identifier", "a", "/artists"), ("identifier", "b", "/ARTISTS")], "a"), ("/x/12", [("identifier", "i", "/x"), ("map", "m", "/x/[number]")], "i"),
        ("/x/12", [("identifier", "i", "/y"), ("map", "m", "/x/[number]")], "m"), ("", [("identifier", "home", "^/$")], "home"), ("/", [("identifier", "home", "^$")], "home"), ("/x", [("identifier", "bad", "/x(")], "unknown"), ("/works/2001/3", [("identifier", "w", "URL matches /works/[year]/[month]$")], "w"), ("/en/artists", [("identifier", "a", "/artists/?$")], "a"),
    ],
)
def test_the_longest_identifier_wins(spark, path, rules, want):
    assert classify(spark, path, *rules) == {1: want, 2: "unknown"}


def test_keys_lose_no_match():
    made = ["/artists/", "/artists/?$", "/a/b/c", "/artists/[name]/works/", "(x|y)/z/", "/en/[number]", "/a+/b/", "/ab*/c/", "/A_b/"]
    paths = ["/artists/x", "/artists", "/en/artists/jo/works/1", "/a/b/c", "/a/b/cd", "/x/z/", "/en/5", "/aaa/b/", "/a/c/", "/a_b/", "/q/artists/"]
    for pattern in made:
        text, _, key = P.compiled(pattern, "identifier")
        for path in paths:
            if re.search(text, path, re.IGNORECASE):
                assert key == "*" or key in path.lower().split("/"), (pattern, path)
    assert P.compiled("/artists/[name]/works/", "identifier")[2] == "artists" and P.compiled("/artists/[letter]", "map_end")[2] == "artists" and P.compiled("/artists", "map_end")[2] == "artists" and P.compiled("/artists", "identifier")[2] == "*"


def test_the_first_pattern_of_a_map(spark):
    pages = spark.createDataFrame([(1, "s", "/en/artists/a"), (2, "s", "/artists/ab"), (3, "s", "/artists/a/b"), (4, "s", "/file.html"), (5, "s", "/fileXhtml")], "id int, source_id string, path string")
    rules = spark.createDataFrame([("s", 0, "/artists/[letter]", "letter", "x"), ("s", 1, "/artists/[name]", "artist", "y"), ("s", 2, ".html", "file", None)], "source_id string, rule int, pattern string, page_type string, expected_fields string")
    assert {r["id"]: (r["page_type"], r["expected_fields"]) for r in P.structure_classify(pages, rules).collect()} == {1: ("letter", "x"), 2: ("artist", "y"), 3: (None, None), 4: ("file", None), 5: (None, None)}


def test_record_types_fall_back_in_order(spark):
    types = spark.createDataFrame([("s", t) for t in ("a", "b", "c", "event_detail", "odd")], "source_id string, page_type string")
    targets = spark.createDataFrame([("s", "a", 2, 0, "map"), ("s", "a", 0, 0, " Rule "), ("s", "b", 1, 0, ""), ("s", "b", 1, 1, "list"), ("s", "c", 2, 1, "late"), ("s", "c", 2, 0, "MAP"), ("t", "odd", 0, 0, "x")], "source_id string, page_type string, level int, place int, target string")
    assert {r["page_type"]: r["record_type"] for r in P.record_types(types, targets).collect()} == {"a": "rule", "b": "list", "c": "map", "event_detail": "event", "odd": "artwork"}


def test_roles(spark):
    urls = ["http://A.com/x/1", "http://a.com/y", "http://www.art.co.za/artists/", "http://www.art.co.za/artists/b", "http://www.art.co.za/jane/About.php", "http://www.art.co.za/jane/odd.php", "http://www.art.co.za/jane", "http://www.art.co.za/events", "http://b.com/jane"]
    rules = spark.createDataFrame([("a.com", 1, "^/", "any"), ("a.com", 0, "/[0-9]+$", "number")], "host string, place int, pattern string, role string")
    got = {r["id"]: r["role"] for r in P.page_role(spark.createDataFrame(list(enumerate(urls)), "id int, url string"), rules).collect()}
    assert list(map(got.get, range(9))) == ["number", "any", "artist_directory_root", "artist_directory_letter", "artist_biography", "artist_related_page", "artist_profile_hub", None, None]
