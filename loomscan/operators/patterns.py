"""URL rules as a table: patterns are compiled once, and a page meets only those of its source whose whole path parts it has.

A pattern's part between two slashes, if it is plain text, must be a part of any path that matches; the longest such part is
the rule's key. Rules without one are met by all pages of their source. Only what has met is searched with the expression.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions import urls as U
from loomscan.sources.views import view, with_views

#: What the tokens of an identifier stand for; of a map's pattern, which is plain text beside them and reaches to the path's end; and how tokens count in a pattern's length.
IDENTIFIER_TOKENS = {"[letter]": "[a-z]", "[name]": "[a-z0-9-]+", "[page]": r"\d+", "[number]": r"\d+", "[year]": r"\d{4}", "[month]": r"\d{1,2}", "[id]": "[^/]+"}
MAP_TOKENS = {"[letter]": "[a-z]", "[number]": r"\d+", "[page]": r"\d+", "[name]": "[^/]+", "[id]": "[^/]+"}
TOKEN_LENGTHS = {"[letter]": 1, "[number]": 1, "[page]": 1, "[name]": 1, "[id]": 1}
#: Record types of page types that no rule gives one, and that of all others.
PAGE_RECORDS = {"artist_profile": "artist", "artist": "artist", "event_detail": "event", "event": "event", "exhibition_detail": "exhibition", "exhibition": "exhibition", "venue_profile": "venue", "venue": "venue", "artwork_detail": "artwork", "artwork": "artwork"}
OTHER_RECORD = "artwork"
#: The host of a directory site, the roles of its pages by their name, and the first parts of its paths that are no artist.
DIRECTORY_HOST = "www.art.co.za"
DIRECTORY_PAGES = {"about.php": "artist_biography", "exhibitions.php": "artist_exhibitions", "articles.php": "artist_articles", "press.php": "artist_press", "memories.php": "artist_memories"}
DIRECTORY_PARTS = ("artists", "galleries", "gallery", "events", "exhibitions")
_PREFIX = "url matches "


def _key(pattern: str, tokens: dict[str, str], ends: bool) -> str:
    """The longest plain part that any matching path has as a whole, lower-cased; * without one."""
    bare = functools.reduce(lambda p, t: p.replace(t, "\0"), tokens, pattern)
    if ends:
        bare += "/"
    elif re.search(r"[|()\[\]{}\\+*^$.]", bare):
        return "*"
    found = [m[1] for m in re.finditer(r"(?<=/)([A-Za-z0-9_-]+)(?=/(?![?*+{]))", bare)]
    return max(found, key=lambda x: (len(x), x), default="*").lower()


def compiled(pattern: str | None, kind: str) -> tuple[str, int, str] | None:
    """(expression, length, key) of an identifier or of a map's pattern; None for one that is empty or no expression."""
    if not pattern:
        return None
    length = len(functools.reduce(lambda p, t: p.replace(t[0], "x" * t[1]), TOKEN_LENGTHS.items(), pattern))
    if kind == "map_end":
        tokens, text = MAP_TOKENS, functools.reduce(lambda p, t: p.replace(re.escape(t[0]), t[1]), MAP_TOKENS.items(), re.escape(pattern)) + "$"
        return text, length, _key(pattern, tokens, True)
    text = pattern.strip()
    if text.lower().startswith(_PREFIX):
        text = text[len(_PREFIX) :].strip()
    key = _key(text, IDENTIFIER_TOKENS, False)
    text = functools.reduce(lambda p, t: p.replace(t[0], t[1]), IDENTIFIER_TOKENS.items(), text)
    try:
        re.compile(text)
    except re.error:
        return None
    return text, length, key


def _met(pages: DataFrame, rules: DataFrame, both_roots: bool) -> DataFrame:
    """Rows of pages (id, source_id, path) and rules (source_id, kind, pattern and more) that match, case aside; both_roots: an empty path and / stand for each other."""
    made = rules.withColumn("c", F.udf(compiled, "struct<expression:string,length:int,key:string>", useArrow=False)("pattern", "kind")).where("c is not null").select("*", "c.*").drop("c")
    parts = F.array_distinct(F.concat(F.array(F.lit("*")), F.filter(F.split(F.lower("path"), "/"), lambda x: x != "")))
    hit = F.expr("path rlike concat('(?i)', expression)")
    if both_roots:
        other = F.when(F.col("path") == "", "/").when(F.col("path") == "/", "")
        hit = hit | F.coalesce(F.expr("_other rlike concat('(?i)', expression)"), F.lit(False))
        pages = pages.withColumn("_other", other)
    return pages.withColumn("key", F.explode(parts)).join(made, ["source_id", "key"]).where(hit)


def rule_classify(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, page_type): of the identifiers that match a page's path the longest, tokens counting as one character, then the earliest; else so of the map's patterns; else unknown.

    rules: source_id, rule (their order), kind (identifier or map), page_type, pattern. Patterns are expressions searched anywhere in the path.
    """
    rank = F.struct((F.col("kind") == "identifier").alias("first"), "length", (-F.col("rule")).alias("early"), "page_type")
    best = _met(pages.select("id", "source_id", "path"), rules, True).groupBy("id").agg(F.max(rank)["page_type"].alias("page_type"))
    return pages.select("id").join(best, "id", "left").select("id", F.coalesce("page_type", F.lit("unknown")).alias("page_type"))


def structure_classify(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, page_type, expected_fields): the first of the source's map patterns (source_id, rule, page_type, pattern, expected_fields) that the end of the path is; nulls where none is."""
    hits = _met(pages.select("id", "source_id", "path"), rules.withColumn("kind", F.lit("map_end")), False)
    best = hits.groupBy("id").agg(F.min(F.struct("rule", "page_type", "expected_fields")).alias("b"))
    return pages.select("id").join(best, "id", "left").select("id", "b.page_type", "b.expected_fields")


def record_types(types: DataFrame, targets: DataFrame) -> DataFrame:
    """types (source_id, page_type and more) with record_type: the first target of the source for that page type, by level and place, else the fixed one.

    targets: source_id, page_type, level (0 the type's rule, 1 its list of types, 2 the map), place, target; blank ones count for nothing.
    """
    first = targets.where("trim(target) <> ''").groupBy("source_id", "page_type").agg(F.min(F.struct("level", "place", F.lower(F.trim("target")).alias("target")))["target"].alias("own"))
    fixed = functools.reduce(lambda w, x: w.when(F.col("page_type") == x[0], x[1]), PAGE_RECORDS.items(), F.when(F.lit(False), ""))
    return types.join(first, ["source_id", "page_type"], "left").withColumn("record_type", F.coalesce("own", fixed, F.lit(OTHER_RECORD))).drop("own")


def _directory_role(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(F.lower(path), "/+$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    name = F.get(parts, 1)
    page = functools.reduce(lambda w, x: w.when(name == x[0], x[1]), DIRECTORY_PAGES.items(), F.when(F.lit(False), "")).otherwise("artist_related_page")
    role = F.when(bare == "/artists", "artist_directory_root").when(bare.rlike("^/artists/[a-z]$"), "artist_directory_letter").when((F.size(parts) == 2) & name.endswith(".php"), page).when((F.size(parts) == 1) & ~F.get(parts, 0).isin(*DIRECTORY_PARTS), "artist_profile_hub")
    return F.when(host == DIRECTORY_HOST, role)


def page_role(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, role): the first pattern of the host's rules (host, place, pattern, role) that is found in the path, as it stands; else the directory site's roles; null for all other pages.

    Rules of the host in lower case count where there are none for it as it is written.
    """
    place = F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)
    rows = pages.select("id", place.alias("host"), U.path(F.col("url")).alias("path"))
    known = rules.select("host").distinct().withColumn("_known", F.lit(True))
    keyed = rows.join(known, "host", "left").withColumn("key", F.when(F.col("_known"), F.col("host")).otherwise(F.lower("host")))
    hits = keyed.join(rules.withColumnRenamed("host", "key"), "key").where(F.expr("path rlike pattern")).groupBy("id").agg(F.min(F.struct("place", "role"))["role"].alias("own"))
    return rows.join(hits, "id", "left").select("id", F.coalesce("own", _directory_role(F.lower("host"), F.col("path"))).alias("role"))


IDENTIFIERS = [(0, "identifier", "english", "URL matches /en/"), (1, "identifier", "detail", "/[letter][letter]/[number]"), (2, "identifier", "page", "/en/[number]$"), (3, "map", "document", r"\.html$"), (4, "map", "translated", "/[letter][letter]/"), (5, "identifier", "broken", "/en/(")]
MAP = [(0, "/en/[number]", "detail", "title,body"), (1, "/[letter][letter]/[name]", "named", "title"), (2, ".html", "document", None)]
TARGETS = [("detail", 0, 0, " "), ("detail", 1, 0, " Venue "), ("detail", 1, 1, "event"), ("english", 2, 0, "Exhibition"), ("page", 1, 0, "artist")]
ROLES = [(0, "^/en/[0-9]+$", "english_page"), (1, "^/[a-z]{2}/", "translated")]


def _per_source(s, d, rows, schema):
    """Rules of every source of the pages: the same ones, as a table that grows with the sources."""
    return view(s, d, "pages_v").select("source_id").distinct().withColumn("x", F.explode(F.array(*[F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(r, schema, strict=True)]) for r in rows]))).select("source_id", "x.*")


def _identifiers(s, d):
    return _per_source(s, d, IDENTIFIERS, ("rule int", "kind string", "page_type string", "pattern string"))


QUERIES = {
    "rule_classify": lambda s, d: rule_classify(view(s, d, "pages_v"), _identifiers(s, d)),
    "structure_classify": lambda s, d: structure_classify(view(s, d, "pages_v"), _per_source(s, d, MAP, ("rule int", "pattern string", "page_type string", "expected_fields string"))),
    "record_type_resolve": lambda s, d: record_types(rule_classify(view(s, d, "pages_v"), _identifiers(s, d)).join(view(s, d, "pages_v").select("id", "source_id"), "id"), _per_source(s, d, TARGETS, ("page_type string", "level int", "place int", "target string"))).select("id", "page_type", "record_type"),
    "page_role": lambda s, d: page_role(view(s, d, "pages_v"), _per_source(s, d, ROLES, ("place int", "pattern string", "role string")).withColumnRenamed("source_id", "host")),
}

#: Lengths with tokens as one character: URL matches /en/ 16, /en/[number]$ 6, /[letter][letter]/[number] 5; of the map \\.html$ 7, /[letter][letter]/ 4.
_CLASSES = "c as (select id, case when regexp_matches(path, '(?i)/en/') then 'english' when regexp_matches(path, '(?i)/[a-z][a-z]/\\d+') then 'detail' when regexp_matches(path, '(?i)\\.html$') then 'document' when regexp_matches(path, '(?i)/[a-z][a-z]/') then 'translated' else 'unknown' end as page_type from pages_v)"
ORACLE = {k: with_views(v) for k, v in {
    "rule_classify": f"with {_CLASSES} select * from c",
    "structure_classify": "select id, case when regexp_matches(path, '(?i)/en/\\d+$') then 'detail' when regexp_matches(path, '(?i)/[a-z][a-z]/[^/]+$') then 'named' when regexp_matches(path, '(?i)\\.html$') then 'document' end as page_type, case when regexp_matches(path, '(?i)/en/\\d+$') then 'title,body' when regexp_matches(path, '(?i)/[a-z][a-z]/[^/]+$') then 'title' end as expected_fields from pages_v",
    "record_type_resolve": f"with {_CLASSES} select id, page_type, case page_type when 'detail' then 'venue' when 'english' then 'exhibition' else 'artwork' end as record_type from c",
    "page_role": "select id, case when regexp_matches(path, '^/en/[0-9]+$') then 'english_page' when regexp_matches(path, '^/[a-z]{2}/') then 'translated' end as role from pages_v",
}.items()}
