"""Merges field by field with provenance, conflicts and a change log; merges of rows and edges that can be undone.

Records are taken apart to rows of one field each, so that rules are plain expressions and aggregates over them. Rules that
are told as a loop over records in order are restated by what a record finds before it: the most certain, or the longest,
value so far, which is a running maximum.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.plans.prefix import with_running_max
from loomscan.plans.shared import materialize
from loomscan.sources.views import view, with_views

HIGH = 80


def merge_fields(stored: DataFrame, incoming: DataFrame, high: float = HIGH) -> DataFrame:
    """Rows (id, field, value, items, confidence, source) of stored and of incoming records, merged: the same columns, with rule, before, before_items and other.

    value is null where a field has none; items is set instead for fields that are lists. Lists are joined in order, each item once (array_union, if that adds any). A stored gap
    takes the incoming value (fill_null), equal values the higher confidence; of two values that are both at least `high` the stored one stays (high_conflict_no_overwrite; other
    has the incoming one, its source and confidence); else the incoming one wins if it is more certain (higher_confidence). rule is null where nothing changed.
    """
    side = lambda df, x: df.select("id", "field", *[F.col(c).alias(f"{x}_{c}") for c in ("value", "items", "confidence", "source")])
    both = side(stored, "a").join(side(incoming, "b"), ["id", "field"], "full_outer")
    a, b = F.coalesce("a_confidence", F.lit(0.0)), F.coalesce("b_confidence", F.lit(0.0))
    old, new = F.coalesce("a_items", F.array().cast("array<string>")), F.coalesce("b_items", F.array().cast("array<string>"))
    union = F.array_distinct(F.concat(old, new))
    lists = F.col("b_items").isNotNull()
    none = F.col("b_value").isNull() & ~lists
    fill, equal = F.col("a_value").isNull() & ~lists, F.col("a_value") == F.col("b_value")
    clash = ~none & ~lists & ~fill & ~equal & (a >= high) & (b >= high)
    wins = ~none & ~lists & ~fill & ~equal & ~clash & (b > a)
    clash, wins = F.coalesce(clash, F.lit(False)), F.coalesce(wins, F.lit(False))
    rule = F.when(none, None).when(lists & (union != old), "array_union").when(lists, None).when(fill, "fill_null").when(equal, None).when(clash, "high_conflict_no_overwrite").when(wins, "higher_confidence")
    taken = ~none & ~lists & (fill | wins)
    return both.select(
        "id", "field", F.when(taken, F.col("b_value")).otherwise(F.col("a_value")).alias("value"), F.when(lists, union).otherwise(F.col("a_items")).alias("items"),
        F.when(none, F.col("a_confidence")).when(lists | (~fill & F.coalesce(equal, F.lit(False))), F.greatest(a, b)).when(taken, b).otherwise(F.col("a_confidence")).alias("confidence"),
        F.when(~none & (lists | taken), F.col("b_source")).otherwise(F.col("a_source")).alias("source"), rule.alias("rule"), F.when(rule.isNotNull(), F.col("a_value")).alias("before"), F.when(rule.isNotNull(), F.col("a_items")).alias("before_items"),
        F.when(clash, F.struct(F.col("b_value").alias("value"), F.col("b_source").alias("source"), b.alias("confidence"))).alias("other"),
    )


def field_conflicts(merged: DataFrame) -> DataFrame:
    """(id, field, value, source, confidence, selected): both values of every double-high conflict."""
    hit = merged.where(F.col("other").isNotNull())
    kept = hit.select("id", "field", "value", "source", "confidence", F.lit(True).alias("selected"))
    return kept.unionByName(hit.select("id", "field", "other.value", "other.source", "other.confidence", F.lit(False).alias("selected")))


def merge_snapshots(stored: DataFrame, incoming: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, snapshot): as JSON what a record was, what came, what it became, and the rule of each change; fields by name, values as texts or lists."""
    fields = lambda df, name: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "items"))).alias(name))
    text = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    value = lambda x: F.when(x["items"].isNotNull(), text(x["items"])).otherwise(text(x["value"]))
    whole = lambda c: F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(text(x["field"]), F.lit(":"), value(x))), ","), F.lit("")), F.lit("}"))
    changed = merged.where(F.col("rule").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field", "rule"))).alias("changes"))
    rows = fields(merged, "after").join(fields(stored, "before"), "id", "left").join(fields(incoming, "incoming"), "id", "left").join(changed, "id", "left")
    rules = F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform("changes", lambda x: F.concat(text(x["field"]), F.lit(":"), text(x["rule"]))), ","), F.lit("")), F.lit("}"))
    return rows.select("id", F.concat(F.lit('{"merge_event":"deduplication_merge","before":'), whole(F.col("before")), F.lit(',"after":'), whole(F.col("after")), F.lit(',"incoming":'), whole(F.col("incoming")), F.lit(',"changes":'), rules, F.lit("}")).alias("snapshot"))


def merge_into_entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (entity_id, field, seq, record_id, value, confidence), records in order of seq: (entity_id, field, value, confidence, entries) and (entity_id, field, record_id, existing_value, incoming_value, resolution).

    The first value is taken; a later one replaces what differs from it if its confidence is not under any before it, and is noted as replaced or kept_existing. Null and empty values count for nothing.
    Rows that repeat seq and record_id come in order of (file, place), if rows have those two; of such rows with equal confidence the first is what later ones meet.
    """
    there = rows.where(F.col("value").isNotNull() & ~F.col("value").isin("", "[]"))
    best = F.struct("confidence", "seq", "record_id", "value")
    fields = there.groupBy("entity_id", "field").agg(F.max(best).alias("b"), F.count("*").alias("entries")).select("entity_id", "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), "entries")
    ties = ["file", "place"] if "place" in rows.columns else []
    first = F.struct("confidence", "seq", "record_id", (-F.col("place")).alias("early"), "value") if ties else best
    seen = with_running_max(there, ["entity_id", "field"], ["seq", "record_id", *ties], first, "prior")
    differ = seen.where(F.col("prior").isNotNull() & (F.col("prior.value") != F.col("value")))
    return fields, differ.select("entity_id", "field", "record_id", F.col("prior.value").alias("existing_value"), F.col("value").alias("incoming_value"), F.when(F.col("confidence") >= F.col("prior.confidence"), "replaced").otherwise("kept_existing").alias("resolution"))


def merge_entity_data(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (id, field, value, confidence) of entities and (id, winner): (id, field, value, confidence, provenance, merged_ids) of those that stay.

    The winner's own value stays, a gap takes that of the least loser that has one. provenance lists all values with their entity, the winner's first; merged_ids the losers, of any field.
    """
    moved = fields.join(mapping, "id", "left").select(F.coalesce("winner", "id").alias("to"), F.coalesce(F.col("winner") != F.col("id"), F.lit(False)).alias("lost"), "id", "field", "value", "confidence")
    losers = mapping.where("id <> winner").groupBy(F.col("winner").alias("to")).agg(F.array_sort(F.collect_set("id")).alias("merged_ids"))
    there = F.col("value").isNotNull() & (F.col("value") != "")
    one = moved.groupBy("to", "field").agg(F.min(F.when(there, F.struct("lost", "id", "value", "confidence"))).alias("b"), F.array_sort(F.collect_list(F.when(there, F.struct("lost", "id", "value")))).alias("all"))
    told = F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value")))
    return one.join(losers, "to", "left").select(F.col("to").alias("id"), "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), told.alias("provenance"), F.coalesce("merged_ids", F.array().cast("array<long>")).alias("merged_ids"))


def merge_rows(records: DataFrame, edges: DataFrame, pairs: DataFrame, first: list[str], most: list[str], version: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, edges, record log, edge log) after each pair (primary, secondary) became its primary; a record may be in one pair only.

    records: id and more; of the columns `first` the primary's value stays unless it is null or empty, of those `most` the greater counts, all others are the primary's. edges: from_id,
    to_id, edge_type and confidence, one row an edge: the secondary's move to the primary, loops go, edges that meet become one of the greatest confidence. The logs have version and
    what each touched row or edge was before and is after; either may be null. All four are written tables.
    """
    names, edge_names = records.columns, edges.columns
    b = records.select(F.col("id").alias("secondary"), F.struct(*names).alias("other"))
    a = records.join(pairs, records["id"] == pairs["primary"]).join(b, "secondary")
    filled = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.when(F.col(f"other.{c}").cast("string") != "", F.col(f"other.{c}")))
    column = lambda c: filled(c) if c in first else F.greatest(F.col(c), F.col(f"other.{c}")) if c in most else F.col(c)
    merged = a.select(F.struct(*names).alias("before"), F.struct(*[column(c).alias(c) for c in names]).alias("after"), "other")
    record_log = merged.select(F.lit(version).alias("version"), F.explode(F.array(F.struct("before", "after"), F.struct(F.col("other").alias("before"), F.lit(None).cast(records.schema).alias("after")))).alias("x")).select("version", "x.before", "x.after")
    record_log = materialize(record_log, "record-log")
    touched = record_log.select(F.col("before.id").alias("id"))
    new_records = records.join(touched, "id", "left_anti").select(*names).unionByName(record_log.where("after is not null").select("after.*"))

    key = ["from_id", "to_id", "edge_type"]
    move = pairs.where("primary <> secondary").join(records.select(F.col("id").alias("secondary")), "secondary", "left_semi").join(records.select(F.col("id").alias("primary")), "primary", "left_semi")
    x, y = move.select(F.col("secondary").alias("from_id"), F.col("primary").alias("new_from")), move.select(F.col("secondary").alias("to_id"), F.col("primary").alias("new_to"))
    aim = edges.join(x, "from_id", "left").join(y, "to_id", "left").withColumn("new_from", F.coalesce("new_from", "from_id")).withColumn("new_to", F.coalesce("new_to", "to_id"))
    moving = materialize(aim.where("new_from <> from_id or new_to <> to_id"), "moving")
    meet = moving.select(F.col("new_from").alias("from_id"), F.col("new_to").alias("to_id"), "edge_type").distinct()
    standing = materialize(edges.join(moving.select(*key), key, "left_anti").join(meet, key, "left_semi").select(*edge_names), "standing")
    became = moving.select(*[F.col({"from_id": "new_from", "to_id": "new_to"}.get(c, c)).alias(c) for c in edge_names]).where("from_id <> to_id").unionByName(standing).groupBy(*key).agg(*[F.max(c).alias(c) for c in edge_names if c not in key]).select(*edge_names)
    none = F.lit(None).cast(edges.schema)
    edge_log = moving.select(*edge_names).unionByName(standing).select(F.lit(version).alias("version"), F.struct(*edge_names).alias("before"), none.alias("after")).unionByName(became.select(F.lit(version).alias("version"), none.alias("before"), F.struct(*edge_names).alias("after")))
    edge_log = materialize(edge_log, "edge-log")
    new_edges = edges.join(moving.select(*key).unionByName(standing.select(*key)), key, "left_anti").select(*edge_names).unionByName(edge_log.where("after is not null").select("after.*"))
    return materialize(new_records, "merged"), materialize(new_edges, "merged-edges"), record_log, edge_log


def undo(rows: DataFrame, log: DataFrame, version: int, key: list[str]) -> DataFrame:
    """rows as they were before a version, of records or of edges; versions are undone from the last one back."""
    own = log.where(F.col("version") == version)
    gone = own.where("after is not null").select(*[F.col(f"after.{c}").alias(c) for c in key])
    return rows.join(gone, key, "left_anti").select(*rows.columns).unionByName(own.where("before is not null").select("before.*"))


#: Fixed values: (what a page gives, the artist's field it goes to); a biography page's text is the full biography and replaces an earlier one.
ARTIST_FIELDS = (("name", "artist_name"), ("bio", "bio_short"), ("about", "bio_about"), ("phone", "contact_phone"), ("website_url", "website"), ("email", "email"), ("nationality", "nationality"), ("avatar_url", "avatar_url"), ("birth_year", "birth_year"))


def payload_fields(pages: DataFrame) -> DataFrame:
    """Rows (family, seq, url, page_type, field, value) of pages in order of seq: (family, field, value, sources, conflicts).

    The longest value counts, the earliest of equal ones; of the full biography the last. Sources are the pages that had a value, in order. Conflicts are the values that met a different one, blanks
    aside, when they came or when it came. Null and empty values count for nothing; a field of null or empty values alone has no row.
    """
    renamed = functools.reduce(lambda w, x: w.when(F.col("field") == x[0], x[1]), ARTIST_FIELDS, F.when((F.col("field") == "bio") & (F.col("page_type") == "artist_biography"), "bio_full"))
    rows = pages.where(F.col("value").isNotNull() & (F.col("value") != "")).withColumn("field", F.coalesce(renamed, F.col("field")))
    full = F.col("field") == "bio_full"
    rank = F.struct(F.when(full, F.col("seq")).otherwise(F.length(F.trim("value"))).cast("long").alias("size"), (-F.col("seq")).alias("early"), "value")
    group = ["family", "field"]
    seen = with_running_max(rows.withColumn("rank", rank), group, ["seq", "url"], F.col("rank"), "prior")
    fold = lambda c: F.trim(c)
    met = seen.where(F.col("prior").isNotNull() & (fold(F.col("prior.value")) != fold(F.col("value"))) & ~full)
    conflicts = met.select(*group, F.explode(F.array("prior.value", "value")).alias("value")).distinct().groupBy(*group).agg(F.array_sort(F.collect_list("value")).alias("conflicts"))
    sources = rows.groupBy(*group, "url", "page_type").agg(F.min("seq").alias("seq")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "url", "page_type"))), lambda x: x["url"]).alias("sources"))
    best = rows.withColumn("rank", rank).groupBy(*group).agg(F.max("rank").alias("b")).select(*group, F.col("b.value").alias("value"))
    return best.join(sources, group).join(conflicts, group, "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))


def payload_lists(pages: DataFrame) -> DataFrame:
    """Rows (family, seq, url, field, place, item) of pages in order: (family, field, items, sources), every item once, where it first stood."""
    group = ["family", "field"]
    there = pages.where(F.col("item").isNotNull())
    items = there.groupBy(*group, "item").agg(F.min(F.struct("seq", "place")).alias("at")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))
    sources = there.groupBy(*group, "url").agg(F.min("seq").alias("seq")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda x: x["url"]).alias("sources"))
    return items.join(sources, group)


def _sides(s, d):
    """Records with even ids as stored, the next odd ones as incoming, a row a field; ids are those of the stored ones."""
    r = view(s, d, "records_v")
    list_items = F.array(F.coalesce("nationality", F.lit("none")), F.col("record_type"))
    fields = F.array(
        F.struct(F.lit("city").alias("field"), F.nullif("city", F.lit("")).alias("value"), F.lit(None).cast("array<string>").alias("items"), F.col("confidence_score").cast("double").alias("confidence")),
        F.struct(F.lit("url").alias("field"), F.col("url").alias("value"), F.lit(None).cast("array<string>").alias("items"), F.col("completeness_score").cast("double").alias("confidence")),
        F.struct(F.lit("mediums").alias("field"), F.lit(None).cast("string").alias("value"), list_items.alias("items"), F.col("confidence_score").cast("double").alias("confidence")),
    )
    rows = r.select("id", F.col("source_id").alias("source"), F.explode(fields).alias("x")).select("id", "x.field", "x.value", "x.items", "x.confidence", "source")
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumn("id", F.col("id") - 1)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join("items", ",")).withColumn("before_items", F.array_join("before_items", ",")).withColumn("other", F.col("other.value"))


def _entity_rows(s, d):
    """Lines of orders as records of parts: the supplier and the flag of each. Some lines repeat order and number; they count in the order of the file."""
    fields = F.array(F.struct(F.lit("source").alias("field"), F.col("l_suppkey").cast("string").alias("value")), F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value")))
    lines = view(s, d, "lineitem").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    return lines.select(F.col("l_partkey").alias("entity_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_orderkey").alias("seq"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.explode(fields).alias("x"), "file", "place").select("entity_id", "record_id", "seq", "confidence", "x.field", "x.value", "file", "place")


def _graph(s, d):
    """Records, and edges of parts and suppliers between them, one a key; pairs of an even id and the next."""
    records = view(s, d, "records_v").select("id", "city", "url", "confidence_score", "completeness_score")
    n = F.lit(997)
    edges = view(s, d, "edges_v").groupBy((F.col("from_id") % n).alias("from_id"), (F.col("to_id") % n).alias("to_id"), "edge_type").agg(F.round(F.max("confidence"), 2).alias("confidence"))
    return records, edges, records.where("id % 4 = 0").select(F.col("id").alias("primary"), (F.col("id") + 1).alias("secondary"))


FIRST, MOST = ["city", "url"], ["confidence_score", "completeness_score"]


def _chain(s, d):
    """Two versions of merges, the second of what the first left, undone from the last back."""
    records, edges, pairs = _graph(s, d)
    r1, e1, rl1, el1 = merge_rows(records, edges, pairs, FIRST, MOST, 1)
    r2, e2, rl2, el2 = merge_rows(r1, e1, r1.where("id % 8 = 0").select(F.col("id").alias("primary"), (F.col("id") + 4).alias("secondary")), FIRST, MOST, 2)
    key = ["from_id", "to_id", "edge_type"]
    return undo(undo(r2, rl2, 2, ["id"]), rl1, 1, ["id"]), undo(undo(e2, el2, 2, key), el1, 1, key)


def _pages_of(s, d):
    """Records as pages of a family each source is: short texts, some of biographies."""
    r = view(s, d, "records_v").withColumn("page_type", F.when(F.col("id") % 7 == 0, "artist_biography").otherwise("artist_profile"))
    fields = F.array(F.struct(F.lit("name").alias("field"), F.col("title").alias("value")), F.struct(F.lit("bio").alias("field"), F.col("nationality").alias("value")), F.struct(F.lit("email").alias("field"), F.col("city").alias("value")))
    return r.select(F.col("source_id").alias("family"), F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("url"), "page_type", F.explode(fields).alias("x")).select("family", "seq", "url", "page_type", "x.field", "x.value")


QUERIES = {
    "merge_record": lambda s, d: _flat(merge_fields(*_sides(s, d))),
    "merge_snapshot": lambda s, d: merge_snapshots(*_sides(s, d), merge_fields(*_sides(s, d))),
    "merge_into_entity": lambda s, d: merge_into_entities(_entity_rows(s, d))[0],
    "merge_into_entity_conflicts": lambda s, d: merge_into_entities(_entity_rows(s, d))[1],
    "merge_entity_data": lambda s, d: merge_entity_data(view(s, d, "entities_v").select("id", F.lit("city").alias("field"), F.when(F.col("id") % 10 != 5, F.col("city")).alias("value"), F.round("confidence", 2).alias("confidence")), view(s, d, "entities_v").where("id % 5 = 1").select("id", (F.col("id") - 1).alias("winner"))).select("id", "field", "value", "confidence", F.array_join(F.transform("provenance", lambda x: F.concat_ws(":", x["id"].cast("string"), x["value"])), ",").alias("provenance"), F.array_join(F.transform("merged_ids", lambda x: x.cast("string")), ",").alias("merged_ids")),
    "merge_artists": lambda s, d: merge_rows(*_graph(s, d), FIRST, MOST, 1)[0],
    "merge_artist_edges": lambda s, d: merge_rows(*_graph(s, d), FIRST, MOST, 1)[1],
    "rollback_merge": lambda s, d: _chain(s, d)[0],
    "rollback_merge_edges": lambda s, d: _chain(s, d)[1],
    "artist_payload_merge": lambda s, d: payload_fields(_pages_of(s, d)).select("family", "field", "value", F.size("sources").alias("sources"), F.get("sources", 0).alias("first_source"), F.array_join("conflicts", "|").alias("conflicts")),
}

_EDGE = "g as (select from_id % 997 as from_id, to_id % 997 as to_id, edge_type, round(max(confidence), 2) as confidence from edges_v group by 1, 2, 3)"
_BOTH = """f as (select id, source_id, nullif(city, '') as city, url, [coalesce(nationality, 'none'), record_type] as items, confidence_score::double as c, completeness_score::double as k from records_v),
    u as (select id, 'city' as field, city as value, null::varchar[] as items, c as confidence, source_id as source from f union all select id, 'url', url, null, k, source_id from f union all select id, 'mediums', null, items, c, source_id from f),
    m as (select coalesce(a.id, b.id - 1) as id, coalesce(a.field, b.field) as field, a.value as av, b.value as bv, a.items as ai, b.items as bi, a.confidence as ac, b.confidence as bc, a.source as xs, b.source as ys from (select * from u where id % 2 = 0) a full join (select * from u where id % 2 = 1) b on b.id = a.id + 1 and b.field = a.field),
    r as (select *, case when bi is not null then list_reduce(list_prepend([]::varchar[], list_transform(list_concat(coalesce(ai, []), bi), lambda x: [x])), lambda x, y: case when list_contains(x, y[1]) then x else list_concat(x, y) end) else ai end as ni from m),
    t as (select *, case when bi is not null then case when ni is distinct from coalesce(ai, []) then 'array_union' end when bv is null then null when av is null then 'fill_null' when av = bv then null when ac >= 80 and bc >= 80 then 'high_conflict_no_overwrite' when bc > ac then 'higher_confidence' end as rule from r)"""
_PAY = """x as (select source_id as family, id as seq, 'p' || id as url, case when id % 7 = 0 then 'bio_full' else 'bio_short' end as bio, title, nationality, city from records_v),
    p as (select family, seq, url, 'artist_name' as field, title as value from x union all select family, seq, url, bio, nationality from x union all select family, seq, url, 'email', city from x), v as (select *, length(trim(value)) as n from p where coalesce(value, '') <> ''),
    b as (select *, case when field = 'bio_full' then null else arg_max(value, (n, -seq)) over w end as prior from v window w as (partition by family, field order by seq rows between unbounded preceding and 1 preceding)),
    c as (select family, field, unnest([prior, value]) as value from b where trim(prior) <> trim(value))"""
ORACLE = {k: with_views(v) for k, v in {
    "merge_record": f"with {_BOTH} select id, field, case when rule in ('fill_null', 'higher_confidence') then bv else av end as value, array_to_string(ni, ',') as items, case when bi is not null or av = bv then greatest(coalesce(ac, 0), coalesce(bc, 0)) when bv is null then ac when rule in ('fill_null', 'higher_confidence') then bc else ac end as confidence, case when bi is not null or rule in ('fill_null', 'higher_confidence') then ys else xs end as source, rule, case when rule is not null then av end as before, case when rule is not null then array_to_string(ai, ',') end as before_items, case when rule = 'high_conflict_no_overwrite' then bv end as other from t",
    "merge_into_entity": "with r as (select from_id as entity_id, record_id as seq, record_id * 10 + line as rid, round(confidence, 2) as c, unnest(['source', 'flag']) as field, unnest([to_id::varchar, edge_type]) as value from edges_v), l as (select entity_id, field, count(*) as entries, list({'c': c, 'v': value} order by seq, rid) as e from r where coalesce(value, '') <> '' group by 1, 2), f as (select *, list_reduce(e, lambda a, x: case when x.c >= a.c then x else a end) as b from l) select entity_id, field, b.v as value, b.c as confidence, entries from f",
    "merge_into_entity_conflicts": "with r as (select from_id as entity_id, record_id as seq, record_id * 10 + line as record_id, round(confidence, 2) as c, unnest(['source', 'flag']) as field, unnest([to_id::varchar, edge_type]) as value from edges_v), p as (select *, arg_max(value, (c, seq, record_id)) over w as prior, max(c) over w as best from r window w as (partition by entity_id, field order by seq, record_id rows between unbounded preceding and 1 preceding)) select entity_id, field, record_id, prior as existing_value, value as incoming_value, case when c >= best then 'replaced' else 'kept_existing' end as resolution from p where prior <> value",
    "merge_entity_data": "with m as (select id, id - 1 as winner from entities_v where id % 5 = 1), e as (select coalesce(winner, e.id) as t, winner is not null as lost, e.id, case when e.id % 10 <> 5 then city end as v, round(confidence, 2) as c from entities_v e left join m on m.id = e.id) select t as id, 'city' as field, arg_min(v, (lost, id)) filter (where v <> '') as value, arg_min(c, (lost, id)) filter (where v <> '') as confidence, coalesce(string_agg(id || ':' || v, ',' order by lost, id) filter (where v <> ''), '') as provenance, coalesce(string_agg(id::varchar, ',' order by id) filter (where lost), '') as merged_ids from e group by 1",
    "merge_artists": "select a.id, coalesce(nullif(a.city, ''), nullif(b.city, '')) as city, coalesce(nullif(a.url, ''), nullif(b.url, '')) as url, greatest(a.confidence_score, b.confidence_score) as confidence_score, greatest(a.completeness_score, b.completeness_score) as completeness_score from records_v a join records_v b on b.id = a.id + 1 where a.id % 4 = 0 union all select id, city, url, confidence_score, completeness_score from records_v where id % 4 > 1 or (id % 4 = 0 and id + 1 not in (select id from records_v)) or (id % 4 = 1 and id - 1 not in (select id from records_v))",
    "merge_artist_edges": f"with {_EDGE}, s as (select a.id + 1 as id, a.id as w from records_v a join records_v b on b.id = a.id + 1 where a.id % 4 = 0), x as (select coalesce(p.w, from_id) as a, coalesce(q.w, to_id) as b, p.w is not null or q.w is not null as moved, edge_type, confidence from g left join s p on p.id = from_id left join s q on q.id = to_id) select a as from_id, b as to_id, edge_type, max(confidence) as confidence from x where a <> b or not moved group by 1, 2, 3",
    "rollback_merge": "select id, city, url, confidence_score, completeness_score from records_v",
    "rollback_merge_edges": f"with {_EDGE} select * from g",
    "artist_payload_merge": f"with {_PAY}, d as (select family, field, string_agg(distinct value, '|' order by value) as conflicts from c group by 1, 2) select v.family, v.field, case when v.field = 'bio_full' then arg_max(value, seq) else arg_max(value, (n, -seq)) end as value, count(*)::int as sources, arg_min(url, seq) as first_source, coalesce(any_value(conflicts), '') as conflicts from v left join d on d.family = v.family and d.field = v.field group by 1, 2",
}.items()}
