"""Joins over records, pages, edges and rules. Small rule tables are left to the optimiser, which broadcasts them by their size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions import urls as U
from loomscan.sources.views import view, with_views


def uncrawled(records: DataFrame, pages: DataFrame) -> DataFrame:
    return records.where("url is not null").join(pages.select("url"), "url", "left_anti")


def records_for_entity(links: DataFrame, records: DataFrame, entity: int) -> DataFrame:
    return links.where(F.col("entity_id") == entity).join(records, links["record_id"] == records["id"]).orderBy(F.desc("updated_at"), "id")


def with_both(reviews: DataFrame, records: DataFrame, column: str, how: str = "left") -> DataFrame:
    """The column of the left and of the right record of each review."""
    one = records.select(F.col("id").alias("left_id"), F.col(column).alias(f"left_{column}"))
    two = records.select(F.col("id").alias("right_id"), F.col(column).alias(f"right_{column}"))
    return reviews.join(one, "left_id", how).join(two, "right_id", how)


def with_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """Records with the number of images and the URL of the primary one, that of least id."""
    per = images.groupBy("record_id").agg(F.count("*").alias("image_count"), F.min_by("image_url", "image_id").alias("primary_url"))
    return records.join(per, records["id"] == per["record_id"], "left").drop("record_id").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


def member_of(people: DataFrame, lists: DataFrame, name: str, names: Column) -> DataFrame:
    """People whose folded name stands in a row's list."""
    flat = lists.select(F.col("id").alias("list_id"), F.explode(F.array_distinct(F.transform(names, F.lower))).alias("key"))
    return spread_join(people.withColumn("key", F.lower(F.trim(name))), "id", flat, "list_id")


def spread_join(left: DataFrame, left_id: str, right: DataFrame, right_id: str, pairs: int = 1 << 22) -> DataFrame:
    """left and right joined on key. A key of more pairs than `pairs` is dealt to a grid by the ids, both sides cut alike, and there are as many tasks as there are so many pairs: a task stays as long as it is."""
    one, two = (df.where("key is not null").groupBy("key").agg(F.count("*").alias(n)) for df, n in ((left, "lefts"), (right, "rights")))
    sizes = one.join(two, "key").select("key", (F.col("lefts").cast("double") * F.col("rights")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= pairs:
        return left.join(right, "key")
    hot = sizes.where(F.col("n") > pairs).select("key", F.ceil(F.sqrt(F.col("n") / pairs)).cast("int").alias("_cuts"))
    deal = lambda df, own, mine, other: df.join(hot, "key", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1))).withColumn(mine, F.pmod(F.xxhash64(own), F.col("_cuts")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")
    on = ["key", "_row", "_column"]
    tasks = min(20_000, max(math.ceil(total / pairs), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return deal(left, left_id, "_row", "_column").repartition(tasks, *on).join(deal(right, right_id, "_column", "_row").repartition(tasks, *on), on).drop("_row", "_column")


def related_events(venues: DataFrame, events: DataFrame) -> DataFrame:
    """(side, id, venue, event, matches): venues (id, title) and events (id, venue_name) of equal folded title, a row each.

    A title is one class: venue and event are its least ids, and stand for all of its pairs; matches is how many of the other side a row is related to. Empty titles are related to none,
    titles of blanks to the events whose venue name is missing, empty or blank.
    """
    fold = lambda c: F.lower(F.trim(c))
    v, e = venues.where("title <> ''").select("id", fold("title").alias("key")), events.select("id", fold(F.coalesce("venue_name", F.lit(""))).alias("key"))
    both = v.groupBy("key").agg(F.min("id").alias("venue"), F.count("*").alias("venues")).join(e.groupBy("key").agg(F.min("id").alias("event"), F.count("*").alias("events")), "key")
    side = lambda df, name, n: df.join(both, "key").select(F.lit(name).alias("side"), "id", "venue", "event", F.col(n).alias("matches"))
    return side(v, "venue", "events").unionByName(side(e, "event", "venues"))


def title_lookup(wanted: DataFrame, records: DataFrame, types: list[str]) -> DataFrame:
    """For each wanted (source_id, title) the record of equal folded title: earlier type first, then least id."""
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("record_type"))
    own = records.where(F.col("record_type").isin(types)).select("source_id", F.lower(F.trim("title")).alias("key"), "id", rank.alias("rank"))
    first = own.groupBy("source_id", "key").agg(F.min(F.struct("rank", "id")).alias("best")).select("source_id", "key", F.col("best.id").alias("found"))
    return wanted.withColumn("key", F.lower(F.trim("title"))).join(first, ["source_id", "key"])


def ego_graph(edges: DataFrame, node: int) -> DataFrame:
    """Edges out of and into a node, once each."""
    out = edges.where(F.col("from_id") == node).select(F.col("to_id").alias("other"), "edge_type", F.lit("out").alias("direction"))
    into = edges.where(F.col("to_id") == node).select(F.col("from_id").alias("other"), "edge_type", F.lit("in").alias("direction"))
    return out.unionByName(into).dropDuplicates()


def family_pages(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """Pages one of whose path parts is a slug: an equi-join on the parts, not a substring scan of all pairs."""
    parts = pages.select("id", "url", F.explode(F.array_distinct(F.filter(F.split(U.path(F.col("url")), "/"), lambda x: x != ""))).alias("slug"))
    return parts.join(slugs, "slug")


def mapping_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    a, b = old.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_old")), new.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))


def _images(p):
    return p.select((F.col("id") % 40).alias("record_id"), F.col("id").alias("image_id"), F.col("url").alias("image_url"))


def _lists(x):
    return x.select("id", F.array(F.col("name"), F.col("city")).alias("names"))


QUERIES = {
    "find_uncrawled_urls": lambda s, d: uncrawled(view(s, d, "records_v"), view(s, d, "pages_v")).select("id", "url"),
    "records_for_entity": lambda s, d: records_for_entity(view(s, d, "links_v").withColumn("record_id", F.col("record_id") % 900), view(s, d, "records_v"), 5).select("id", "entity_id", "updated_at"),
    "reviews_for_source": lambda s, d: with_both(view(s, d, "reviews_v"), view(s, d, "jobs_v"), "source_id").where("left_source_id = 11 or right_source_id = 11").select("id", "left_id", "right_id"),
    "duplicate_reviews_named": lambda s, d: with_both(view(s, d, "reviews_v"), view(s, d, "records_v"), "title").select("id", "left_title", "right_title", (F.col("score") / 100).alias("score")),
    "records_with_images": lambda s, d: with_images(view(s, d, "records_v"), _images(view(s, d, "pages_v"))).select("id", "image_count", "primary_url"),
    "related_exhibitions": lambda s, d: member_of(view(s, d, "entities_v").where("entity_type = 'PROMO'").select("id", "name"), _lists(view(s, d, "entities_v").where("entity_type = 'STANDARD'")), "name", F.col("names")).select("id", "list_id"),
    "related_events": lambda s, d: related_events(view(s, d, "entities_v").select("id", F.col("name").alias("title")), view(s, d, "entities_v").select("id", F.col("name").alias("venue_name"))),
    "title_lookup": lambda s, d: title_lookup(view(s, d, "records_v").select(F.col("id").alias("wanted"), "source_id", "title"), view(s, d, "records_v"), ["exhibition", "artist", "event"]).select("wanted", "found"),
    "artist_graph": lambda s, d: ego_graph(view(s, d, "edges_v"), 5),
    "family_pages": lambda s, d: family_pages(view(s, d, "pages_v"), s.createDataFrame([("en",), ("de",)], "slug string")).select("id", "slug"),
    "family_lookup": lambda s, d: view(s, d, "log_v").select("id", F.get_json_object("context", "$.k").cast("bigint").alias("key")).join(view(s, d, "entities_v").select(F.col("id").alias("key"), "name"), "key").select("id", "key", "name"),
    "mapping_diff": lambda s, d: mapping_diff(view(s, d, "entities_v").where("id % 5 <> 0").select("id", "entity_type", "city", "name"), view(s, d, "entities_v").where("id % 7 <> 0 or id % 5 = 0").select("id", "entity_type", "city", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("name")).alias("name")), ["id", "entity_type", "city"], "name").groupBy("change").agg(F.count("*").alias("n")),
}


ORACLE = {k: with_views(v) for k, v in {
    "find_uncrawled_urls": "select id, url from records_v r where url is not null and not exists (select 1 from pages_v p where p.url = r.url)",
    "records_for_entity": "select r.id, entity_id, updated_at from links_v l join records_v r on l.record_id % 900 = r.id where entity_id = 5",
    "reviews_for_source": "select v.id, left_id, right_id from reviews_v v left join jobs_v a on a.id = left_id left join jobs_v b on b.id = right_id where a.source_id = 11 or b.source_id = 11",
    "duplicate_reviews_named": "select v.id, a.title as left_title, b.title as right_title, score / 100 as score from reviews_v v left join records_v a on a.id = left_id left join records_v b on b.id = right_id",
    "records_with_images": "with i as (select id % 40 as record_id, count(*) as n, min_by(url, id) as u from pages_v group by 1) select r.id, coalesce(n, 0) as image_count, u as primary_url from records_v r left join i on i.record_id = r.id",
    "related_exhibitions": "select a.id, b.id as list_id from entities_v a join entities_v b on lower(trim(a.name)) in (lower(b.name), lower(b.city)) where a.entity_type = 'PROMO' and b.entity_type = 'STANDARD'",
    "related_events": "with v as (select id, lower(trim(name)) as k from entities_v where name <> ''), e as (select id, lower(trim(coalesce(name, ''))) as k from entities_v), b as (select k, venue, venues, event, events from (select k, min(id) as venue, count(*) as venues from v group by 1) join (select k, min(id) as event, count(*) as events from e group by 1) using (k)) select 'venue' as side, id, venue, event, events as matches from v join b using (k) union all select 'event', id, venue, event, venues from e join b using (k)",
    "title_lookup": "with o as (select source_id, lower(trim(title)) as k, id, row_number() over (partition by source_id, lower(trim(title)) order by case record_type when 'exhibition' then 1 when 'artist' then 2 else 3 end, id) as n from records_v where record_type in ('exhibition', 'artist', 'event')) select r.id as wanted, o.id as found from records_v r join o on n = 1 and o.source_id = r.source_id and o.k = lower(trim(r.title))",
    "artist_graph": "select to_id as other, edge_type, 'out' as direction from edges_v where from_id = 5 union select from_id, edge_type, 'in' from edges_v where to_id = 5",
    "family_pages": "select id, slug from pages_v, (values ('en'), ('de')) s(slug) where contains(path || '/', '/' || slug || '/')",
    "family_lookup": "with l as (select id, cast(context->>'$.k' as bigint) as key from log_v) select l.id, key, name from l join entities_v e on e.id = key",
    "mapping_diff": "with a as (select id, name from entities_v where id % 5 <> 0), b as (select id, case when id % 3 = 0 then 'x' else name end as name from entities_v where id % 7 <> 0 or id % 5 = 0) select case when a.id is null then 'added' when b.id is null then 'removed' when a.name is not distinct from b.name then 'unchanged' else 'changed' end as change, count(*) as n from a full join b on a.id = b.id group by 1",
}.items()}
