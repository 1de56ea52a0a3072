"""Set and array operations, idempotent inserts and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.sources.views import view, with_views


def union_merge(a: Column, b: Column) -> Column:
    """Both lists in order, each item once."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows, and of the incoming ones the first of each key that is not there yet."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def item_dedupe(items: DataFrame, by: list[str], item: str, order: str) -> DataFrame:
    """The different items (canonical JSON) of each group as one text, each where it came first; a repeat is folded before the group is gathered."""
    first = items.groupBy(*by, item).agg(F.min(order).alias("_at"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", item))), lambda x: x[item]), ",").alias("items"))


def frontier_upsert(stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row per (source_id, url): stored rows stay, new ones come in once as first found.

    On a clash the higher priority holds, and the last family and due time found (by id) that are not empty.
    """
    last = lambda c, there: F.max_by(c, F.when(there, F.col("id")))
    new = found.groupBy("source_id", "url").agg(
        F.max("priority").alias("new_priority"), F.min_by("depth", "id").alias("new_depth"), last("family_key", F.col("family_key") != "").alias("new_family"), last("next_eligible_at", F.col("next_eligible_at").isNotNull()).alias("new_due"),
    )
    both = stored.select("source_id", "url", "priority", "depth", "family_key", "next_eligible_at").join(new, ["source_id", "url"], "full_outer")
    return both.select("source_id", "url", F.greatest("priority", "new_priority").alias("priority"), F.coalesce("depth", "new_depth").alias("depth"), F.coalesce("new_family", "family_key").alias("family_key"), F.coalesce("new_due", "next_eligible_at").alias("next_eligible_at"))


def image_dedupe(images: DataFrame) -> DataFrame:
    """One image per source and folded URL: the record of highest confidence, then least id; occurrences counted."""
    key = F.sha2(F.lower("url"), 256)
    return images.groupBy("source_id", key.alias("url_hash")).agg(F.min_by("record_id", F.struct(-F.col("confidence"), F.col("record_id"))).alias("record_id"), F.max("confidence").alias("confidence"), F.count("*").alias("occurrences"))


def same_content(pages: DataFrame, content: str) -> DataFrame:
    h = F.sha2(F.col(content), 256)
    return pages.groupBy("source_id", h.alias("content_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def _half(p, part):
    return p.where(F.col("id") % 3 == part) if part is not None else p


def _dup(s, d):
    return view(s, d, "records_v").select("source_id", F.col("description").alias("content"), "id")


QUERIES = {
    "array_union_merge": lambda s, d: view(s, d, "entities_v").select("id", F.array_join(union_merge(F.split("name", " "), F.array("city", F.lower("entity_type"), F.element_at(F.split("name", " "), 1))), "|").alias("merged")),
    "item_dedupe": lambda s, d: item_dedupe(view(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct("l_linestatus", "l_returnflag")).alias("item")), ["l_orderkey"], "item", "l_linenumber"),
    "frontier_upsert": lambda s, d: frontier_upsert(view(s, d, "frontier_v").where("id % 3 <> 0"), view(s, d, "frontier_v").where("id % 2 = 0 or id % 3 = 0").withColumn("priority", F.lit(60)).withColumn("family_key", F.when(F.col("id") % 4 > 0, F.concat(F.lit("new:"), "family_key")))),
    "insert_if_absent": lambda s, d: insert_if_absent(view(s, d, "pages_v").where("id % 3 = 0").select("source_id", "id"), view(s, d, "pages_v").select("source_id", "id"), ["source_id"], "id"),
    "image_dedupe": lambda s, d: image_dedupe(view(s, d, "edges_v").select(F.col("to_id").alias("source_id"), F.concat(F.lit("U"), F.col("from_id").cast("string")).alias("url"), F.col("record_id"), F.round("confidence", 2).alias("confidence"))),
    "pages_by_content": lambda s, d: same_content(_dup(s, d), "content"),
}

ORACLE = {k: with_views(v) for k, v in {
    "array_union_merge": "with x as (select id, unnest(list_concat(string_split(name, ' '), [city, lower(entity_type), string_split(name, ' ')[1]])) as w, unnest(range(100)[1:len(list_concat(string_split(name, ' '), [city, lower(entity_type), string_split(name, ' ')[1]]))]) as n from entities_v), f as (select id, w, min(n) as n from x group by 1, 2) select id, string_agg(w, '|' order by n) as merged from f group by 1",
    "item_dedupe": """with i as (select l_orderkey, '{"l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '"}' as item, min(l_linenumber) as n from lineitem group by 1, 2) select l_orderkey, string_agg(item, ',' order by n, item) as items from i group by 1""",
    "frontier_upsert": "with a as (select source_id, url, priority, depth, family_key, next_eligible_at from frontier_v where id % 3 <> 0), b as (select source_id, url, 60 as priority, arg_min(depth, id) as depth, arg_max('new:' || family_key, id) filter (id % 4 > 0 and family_key is not null) as family_key, arg_max(next_eligible_at, id) filter (next_eligible_at is not null) as next_eligible_at from frontier_v where id % 2 = 0 or id % 3 = 0 group by 1, 2) select coalesce(a.source_id, b.source_id) as source_id, coalesce(a.url, b.url) as url, greatest(a.priority, b.priority) as priority, coalesce(a.depth, b.depth) as depth, coalesce(b.family_key, a.family_key) as family_key, coalesce(b.next_eligible_at, a.next_eligible_at) as next_eligible_at from a full join b on a.source_id = b.source_id and a.url = b.url",
    "insert_if_absent": "select source_id, id from pages_v where id % 3 = 0 union all select source_id, min(id) from pages_v where source_id not in (select source_id from pages_v where id % 3 = 0) group by 1",
    "image_dedupe": "with i as (select to_id as source_id, sha256('u' || from_id) as url_hash, record_id, round(confidence, 2) as confidence from edges_v), r as (select *, row_number() over (partition by source_id, url_hash order by confidence desc, record_id) as n, count(*) over (partition by source_id, url_hash) as occurrences from i) select source_id, url_hash, record_id, confidence, occurrences from r where n = 1",
    "pages_by_content": "select source_id, sha256(description) as content_hash, count(*) as n, min(id) as first_id from records_v group by 1, 2 having count(*) > 1",
}.items()}
