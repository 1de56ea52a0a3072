"""Page families, rules, mapping rows and their versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions import urls as U
from loomscan.operators.expressions import MAPPED, SPOKEN, _any
from loomscan.sources.views import view, with_views


#: Added before rounding to two places: halves go up in every engine.
TIE = 1e-9


def first_few(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n (id, url) of each group as an array s: ranks inside hashed parts of a group first, so that no task sorts a whole large one."""
    part = F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")
    near = rows.select(*by, "id", "url", part).withColumn("place", F.row_number().over(Window.partitionBy(*by, "part").orderBy("id"))).where(F.col("place") <= n)
    return near.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "url"))), 1, n).alias("s"))


def url_families(pages: DataFrame, samples: int = 5) -> DataFrame:
    """Pages of a source by path pattern: type, size, mean out-links, confidence, the first URLs by id."""
    p = pages.select("id", "source_id", "url", U.path_pattern(F.col("url")).alias("pattern"), F.regexp_count("html", F.lit("href=")).alias("links"))
    g = p.groupBy("source_id", "pattern").agg(F.count("*").alias("size"), F.round(F.avg("links"), 4).alias("mean_links"))
    g = g.join(first_few(p, ["source_id", "pattern"], samples), ["source_id", "pattern"])
    total = p.groupBy("source_id").agg(F.count("*").alias("total"))
    kind = U.page_type_candidate(F.col("pattern"))
    score = F.least(F.lit(0.98), 0.45 + 0.5 * F.col("size") / F.col("total") + F.when(kind != "generic_detail", 0.1).otherwise(0.0))
    return g.join(total, "source_id").select("source_id", "pattern", kind.alias("page_type"), "size", "mean_links", F.round(score + TIE, 2).alias("confidence"), F.array_join(F.transform("s", lambda x: x["url"]), " ").alias("samples"))


def page_clusters(pages: DataFrame) -> DataFrame:
    p = pages.select("source_id", "id", U.page_type_candidate(U.path_pattern(F.col("url"))).alias("role"))
    total = p.groupBy("source_id").agg(F.count("*").alias("total"))
    g = p.groupBy("source_id", "role").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))
    return g.join(total, "source_id").select("source_id", "role", "size", "first_id", F.round(F.least(F.lit(0.95), 0.5 + 0.5 * F.col("size") / F.col("total")) + TIE, 2).alias("confidence"))


def family_rules(families: DataFrame) -> DataFrame:
    """Resolved type, include, follow, priority and freshness of each family (page_type is the candidate), and whether its signals are in conflict."""
    kind, conflict = U.resolve_page_type(F.col("page_type"), F.col("confidence"), F.col("pattern"))
    t = F.col("resolved")
    return families.withColumn("resolved", kind).withColumn("conflict", conflict).select(
        "source_id", "pattern", t.alias("page_type"), U.include_rule(F.col("pattern"), F.col("confidence"), F.col("size"), t).alias("include"), (t == "listing").alias("follow"),
        F.when(t == "listing", "high").when(t.isin("detail", "artist", "artwork", "exhibition"), "medium").otherwise("low").alias("priority"),
        F.when(t == "listing", "daily").when(U.holds(F.lower("pattern"), U.ARCHIVE_TOKENS), "monthly").otherwise("weekly").alias("freshness"),
        "conflict", (F.col("conflict") & (F.col("confidence") < 0.55)).alias("escalate"),
    )


#: What each kind of cluster is proposed: selector, entity, field, in order; other kinds get generic_page's.
BLUEPRINTS = {
    "detail_event": (("h1", "event", "title"), ("time, .date", "event", "start_date"), (".description, article p", "event", "description")),
    "detail_profile": (("h1", "artist", "title"), (".bio, .about, article p", "artist", "bio"), ("a[href^='http']", "artist", "website_url")),
    "detail_content": (("h1", "organization", "title"), ("article p, .content p", "organization", "description"), ("a[href^='http']", "organization", "website_url")),
    "listing_page": (("main a[href]", "event", "url"), ("main h2, main h3", "event", "title")),
    "directory_index": (("a[href]", "organization", "url"), ("a[href]", "organization", "title")),
    "section_landing": (("h1", "organization", "title"), ("p", "organization", "description")),
    "root_page": (("title", "organization", "title"), ("meta[name='description']", "organization", "description")),
    "detail_page": (("h1", "organization", "title"), ("article p, .content", "organization", "description")),
    "generic_page": (("title", "organization", "title"), ("meta[name='description']", "organization", "description")),
}
OTHER_BLUEPRINT = "generic_page"


def proposals(clusters: DataFrame) -> DataFrame:
    """The mapping rows proposed for clusters (source_id, key, label, confidence): confidence falls by .05 a rank, not under .45; a title's sample is the source's name (source_name)."""
    plans = F.create_map(*[x for k, rows in BLUEPRINTS.items() for x in (F.lit(k), F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("selector", "entity", "field"), r, strict=True)]) for r in rows]))])
    plan = F.coalesce(F.try_element_at(plans, F.col("key")), F.element_at(plans, F.lit(OTHER_BLUEPRINT)))
    made = clusters.select("*", F.posexplode(plan).alias("rank", "b"))
    why = F.concat(F.lit("Cluster '"), "label", F.lit("' mapped to schema blueprint '"), "key", F.lit("'; Selector '"), "b.selector", F.lit("' commonly captures '"), "b.field", F.lit("'"))
    return made.select(
        "source_id", "key", "rank", "b.selector", "b.entity", "b.field", F.when(F.col("b.selector") == "title", F.col("source_name")).otherwise(F.concat(F.lit("sample_"), "b.field")).alias("sample"),
        F.greatest(F.lit(0.45), F.round(F.col("confidence") - 0.05 * F.col("rank") + TIE, 2)).alias("confidence"), why.alias("rationale"),
    )


def preview_rows(rows: DataFrame, least: float = 0.65) -> DataFrame:
    """What each row that is enabled and not rejected gives: its trimmed sample (null if empty) and a warning.

    rows: version_id, sort_order, selector, sample_value, destination_entity, destination_field, category_target, confidence, status, is_enabled. A null status is not rejected, a null confidence is 0.
    """
    value = F.nullif(F.regexp_replace("sample_value", r"^\s+|\s+$", ""), F.lit(""))
    low = F.coalesce("confidence", F.lit(0.0)) < least
    return rows.where("is_enabled and coalesce(status, '') <> 'rejected'").withColumn("value", value).withColumn("warning", F.when(F.col("value").isNull(), "Empty sample value").when(low, "Low confidence mapping - moderation required"))


def mapping_preview(rows: DataFrame, least: float = 0.65) -> DataFrame:
    """(version_id, n_rows, record, sources, categories, warnings) of each version's rows, taken in their order.

    record: the last sample of each field; sources: its selectors; categories: those of each entity, all in order of first sight. warnings
    has a line for every row of low confidence that has a sample. Equal values fold in a partial aggregate before a version's meet.
    """
    r = preview_rows(rows, least)
    e = lambda part, name, item, value: F.struct(F.lit(part).alias("part"), name.alias("name"), item.alias("item"), value.alias("value"))
    none, has = F.lit(None).cast("string"), F.col("value").isNotNull()
    note = F.concat(F.lit("Low confidence extraction for "), F.coalesce("destination_entity", F.lit("None")), F.lit("."), F.coalesce("destination_field", F.lit("None")))
    field, entity = F.coalesce("destination_field", F.lit("")), F.coalesce("destination_entity", F.lit(""))
    every = F.array(
        e("row", F.lit(""), none, none), F.when(has, e("field", field, none, F.col("value"))), F.when(has, e("source", field, F.col("selector"), none)),
        F.when(F.col("category_target") != "", e("category", entity, F.col("category_target"), none)), F.when(has & F.col("warning").isNotNull(), e("warning", note, F.col("sort_order").cast("string"), none)),
    )
    one = r.select("version_id", "sort_order", F.explode(F.array_compact(every)).alias("e")).groupBy("version_id", "e.part", "e.name", "e.item").agg(F.count("*").alias("n"), F.min("sort_order").alias("at"), F.max(F.struct("sort_order", "e.value"))["value"].alias("value"))
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("at", "name", "item", "value", "n")))).alias(part)
    g = one.groupBy("version_id").agg(F.sum(F.when(F.col("part") == "row", F.col("n"))).alias("n_rows"), *map(of, ("field", "source", "category", "warning")))

    def lists(c):
        keys = F.array_distinct(F.transform(c, lambda x: x["name"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(c, lambda x: x["name"] == k), lambda x: x["item"]).alias("value"))))

    record = F.map_from_entries(F.transform("field", lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value"))))
    lines = F.flatten(F.transform("warning", lambda x: F.array_repeat(x["name"], x["n"].cast("int"))))
    return g.select("version_id", "n_rows", record.alias("record"), lists(F.col("source")).alias("sources"), lists(F.col("category")).alias("categories"), lines.alias("warnings"))


def latest_per(df: DataFrame, by: list[str], order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))


def publish(versions: DataFrame, approved: DataFrame) -> DataFrame:
    """The newest version with approved rows is active, older ones superseded, those without approved rows stay drafts."""
    gate = versions.join(approved, "version_id", "left").withColumn("ok", F.coalesce("approved", F.lit(0)) > 0)
    newest = gate.where("ok").groupBy("source_id").agg(F.max("version_id").alias("active_id"))
    j = gate.join(newest, "source_id", "left")
    return j.select("source_id", "version_id", F.when(F.col("version_id") == F.col("active_id"), "active").when(F.col("ok"), "superseded").otherwise("draft").alias("state"))


def decide_rows(rows: DataFrame, events: DataFrame) -> DataFrame:
    """The latest event of each row applies, but only to drafts."""
    last = events.groupBy("row_id").agg(F.max(F.struct("ts", "event_id", "action"))["action"].alias("action"))
    return rows.join(last, rows["id"] == last["row_id"], "left").select("id", F.when(F.col("is_draft"), F.coalesce("action", "status")).otherwise(F.col("status")).alias("status"))


#: The kinds of clusters that the test pages' types stand for.
CLUSTER_KEYS = {"listing": "listing_page", "event": "detail_event", "artist": "detail_profile", "generic_detail": "detail_page"}
#: Samples and confidences of the view's mapping rows, in Spark and DuckDB.
SAMPLED = "case when sort_order % 5 = 0 then null when sort_order % 7 = 0 then '  ' else concat(' v', cast(sort_order % 97 as varchar(20)), ' ') end"
CONFIDENCE = "cast(sort_order % 100 as double) / 100"


def _proposed(s, d):
    key = F.coalesce(*[F.when(F.col("role") == r, k) for r, k in CLUSTER_KEYS.items()], F.col("role"))
    return page_clusters(view(s, d, "pages_v")).select("source_id", key.alias("key"), F.col("role").alias("label"), "confidence", F.col("source_id").alias("source_name"))


def _previewed(s, d):
    rows = view(s, d, "mapping_rows_v").withColumn("sample_value", F.expr(SAMPLED.replace("varchar(20)", "string"))).withColumn("confidence", F.expr(CONFIDENCE)).withColumnRenamed("preset_id", "version_id")
    lists = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ",", "-"))), " | ").alias(c)
    record = F.array_join(F.transform(F.map_entries("record"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " | ")
    return mapping_preview(rows).select("version_id", "n_rows", record.alias("record"), lists("sources"), lists("categories"), F.array_join("warnings", " | ").alias("warnings"))


def _versions(s, d):
    return view(s, d, "jobs_v").select("source_id", F.col("id").alias("version_id"))


def _rowset(s, d):
    return view(s, d, "edges_v").select((F.col("record_id") * 10 + F.col("line")).alias("id"), "record_id", F.col("edge_type").alias("status"), (F.col("line") <= 3).alias("is_draft"), F.col("from_id"), F.round("confidence", 2).alias("confidence"))


QUERIES = {
    "url_families": lambda s, d: url_families(view(s, d, "pages_v")),
    "page_clusters": lambda s, d: page_clusters(view(s, d, "pages_v")),
    "family_rules": lambda s, d: family_rules(url_families(view(s, d, "pages_v"))),
    "mapping_proposals": lambda s, d: proposals(_proposed(s, d)),
    "mapping_preview": _previewed,
    "template_apply": lambda s, d: view(s, d, "sources_v").select("id", F.replace(F.replace(F.lit('{"start":"{url}","host":"{domain}"}'), F.lit("{url}"), F.col("url")), F.lit("{domain}"), U.host(F.col("url"))).alias("config")),
    "version_publish": lambda s, d: publish(_versions(s, d), view(s, d, "edges_v").where("edge_type = 'A'").groupBy(F.col("record_id").alias("version_id")).agg(F.count("*").alias("approved"))),
    "version_rollback": lambda s, d: _versions(s, d).withColumn("n", latest_per(_versions(s, d), ["source_id"], "version_id")).groupBy("source_id").agg(F.coalesce(F.max(F.when(F.col("n") == 2, F.col("version_id"))), F.max("version_id")).alias("active_id")),
    "replace_families": lambda s, d: view(s, d, "pages_v").where("id % 2 = 0").select("source_id", U.path_pattern(F.col("url")).alias("pattern")).distinct().unionByName(view(s, d, "pages_v").select("source_id").subtract(view(s, d, "pages_v").where("id % 2 = 0").select("source_id")).select("source_id", F.lit("/old").alias("pattern"))),
    "refresh_plan": lambda s, d: view(s, d, "frontier_v").where("next_eligible_at is null or next_eligible_at <= timestamp '2024-01-08 02:00:00'").select("id", F.lit("queued").alias("status"), "created_at").orderBy("created_at", "id").limit(500),
    "version_number": lambda s, d: _versions(s, d).groupBy("source_id").agg((F.count("*") + 1).alias("next_version")),
    "row_decisions": lambda s, d: decide_rows(_rowset(s, d), view(s, d, "events").select((F.col("event_id") * 10 + 1).alias("row_id"), "ts", "event_id", F.col("event_type").alias("action"))),
    "source_profile": lambda s, d: view(s, d, "pages_v").groupBy("source_id").agg(F.count("*").alias("pages"), F.count_distinct(U.path_pattern(F.col("url"))).alias("families"), F.min(F.split_part("url", F.lit("://"), F.lit(1))).alias("scheme")),
}

_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_PATTERN = f"'/' || array_to_string(list_transform(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '^[0-9]+$') then '{{num}}' when regexp_matches(x, '^[0-9a-fA-F]{{8,}}$') then '{{hex}}' when regexp_matches(x, '[0-9]') then '{{slug}}' else lower(x) end), '/')"
_TYPE = "case " + " ".join(f"when contains(lower(pattern), '{h}') then '{k}'" for h, k in U.TYPE_HINTS) + " when len(list_filter(string_split(pattern, '/'), lambda x: x <> '')) <= 1 then 'listing' else 'generic_detail' end"
_FAM = f"p as (select id, source_id, url, {_PATTERN} as pattern, len(regexp_extract_all(html, 'href=')) as links from pages_v), g as (select source_id, pattern, {_TYPE} as page_type, count(*) as size, round(avg(links), 4) as mean_links, string_agg(url, ' ' order by id) as urls, sum(count(*)) over (partition by source_id) as total from p group by 1, 2, 3), f as (select source_id, pattern, page_type, size, mean_links, round(least(0.98, 0.45::double + 0.5::double * size / total + case when page_type <> 'generic_detail' then 0.1::double else 0 end) + 1e-9, 2)::double as confidence, array_to_string(string_split(urls, ' ')[1:5], ' ') as samples from g)"
_CLU = f"p as (select id, source_id, {_PATTERN} as pattern from pages_v), r as (select *, {_TYPE} as role from p), c as (select source_id, role, count(*) as size, min(id) as first_id, round(least(0.95, 0.5::double + 0.5::double * count(*) / sum(count(*)) over (partition by source_id)) + 1e-9, 2)::double as confidence from r group by 1, 2)"
_ROWS = "w as (select record_id * 10 + line as id, record_id, edge_type as status, line <= 3 as is_draft, from_id, round(confidence, 2) as confidence from edges_v)"
_CASES = " ".join(f"when '{r}' then '{k}'" for r, k in CLUSTER_KEYS.items())
_PLANS = ", ".join("('{}', {}, '{}', '{}', '{}')".format(k, i, *(x.replace("'", "''") for x in r)) for k, rows in BLUEPRINTS.items() for i, r in enumerate(rows))

ORACLE = {k: with_views(v) for k, v in {
    "url_families": f"with {_FAM} select * from f",
    "page_clusters": f"with {_CLU} select * from c",
    "family_rules": f"with {_FAM}, q as (select *, page_type as k, lower(pattern) as b, lower(pattern) as l from f), r as (select source_id, pattern, size, confidence, case when confidence >= 0.72 then {MAPPED} else {SPOKEN} end as page_type, confidence < 0.72 and {MAPPED} <> {SPOKEN} as conflict from q) select source_id, pattern, page_type, case when {_any('lower(pattern)', (*U.EXCLUDED, *U.UTILITY_FAMILY))} or (confidence < 0.35 and size <= 1) then false when size >= 3 or confidence >= 0.7 then true else page_type in ('listing', 'artist', 'artwork', 'exhibition', 'detail') and confidence >= 0.45 end as include, page_type = 'listing' as follow, case when page_type = 'listing' then 'high' when page_type in ('detail', 'artist', 'artwork', 'exhibition') then 'medium' else 'low' end as priority, case when page_type = 'listing' then 'daily' when regexp_matches(lower(pattern), 'archive|year|past') then 'monthly' else 'weekly' end as freshness, conflict, conflict and confidence < 0.55 as escalate from r",
    "mapping_proposals": f"with {_CLU}, k as (select *, case role {_CASES} else role end as key from c), b(kind, rank, selector, entity, field) as (values {_PLANS}) select source_id, key, rank, selector, entity, field, case when selector = 'title' then source_id else 'sample_' || field end as sample, greatest(0.45, round(confidence - 0.05::double * rank + 1e-9, 2))::double as confidence, 'Cluster ''' || role || ''' mapped to schema blueprint ''' || key || '''; Selector ''' || selector || ''' commonly captures ''' || field || '''' as rationale from k join b on b.kind = case when key in (select kind from b) then key else '{OTHER_BLUEPRINT}' end",
    "mapping_preview": f"with w as (select *, nullif(trim({SAMPLED}), '') as value, {CONFIDENCE} as confidence, coalesce(destination_field, '') as f from mapping_rows_v where is_enabled and status <> 'rejected'), r as (select preset_id, f, min(sort_order) as o, arg_max(value, sort_order) as v from w where value is not null group by all), r2 as (select preset_id, string_agg(f || '=' || v, ' | ' order by o, f) as record from r group by 1), s as (select preset_id, f, coalesce(selector, '-') as sel, min(sort_order) as o from w where value is not null group by all), s2 as (select preset_id, f, min(o) as o, string_agg(sel, ',' order by o) as sels from s group by preset_id, f), s3 as (select preset_id, string_agg(f || '=' || sels, ' | ' order by o, f) as sources from s2 group by 1), c as (select preset_id, coalesce(destination_entity, '') as e, category_target as t, min(sort_order) as o from w where category_target <> '' group by all), c2 as (select preset_id, e, min(o) as o, string_agg(t, ',' order by o) as ts from c group by preset_id, e), c3 as (select preset_id, string_agg(e || '=' || ts, ' | ' order by o, e) as categories from c2 group by 1), n as (select preset_id, count(*) as n_rows, coalesce(string_agg('Low confidence extraction for ' || coalesce(destination_entity, 'None') || '.' || coalesce(destination_field, 'None'), ' | ' order by sort_order) filter (value is not null and confidence < 0.65), '') as warnings from w group by 1) select n.preset_id as version_id, n_rows, coalesce(record, '') as record, coalesce(sources, '') as sources, coalesce(categories, '') as categories, warnings from n left join r2 on r2.preset_id = n.preset_id left join s3 on s3.preset_id = n.preset_id left join c3 on c3.preset_id = n.preset_id",
    "template_apply": "select id, '{\"start\":\"' || url || '\",\"host\":\"' || regexp_extract(url, '://([^/]+)', 1) || '\"}' as config from sources_v",
    "version_publish": "with a as (select record_id, count(*) as n from edges_v where edge_type = 'A' group by 1), v as (select source_id, id as version_id, coalesce(n, 0) > 0 as ok from jobs_v left join a on record_id = id), m as (select source_id, max(version_id) as active_id from v where ok group by 1) select v.source_id, version_id, case when version_id = active_id then 'active' when ok then 'superseded' else 'draft' end as state from v left join m on m.source_id = v.source_id",
    "version_rollback": "with r as (select source_id, id, row_number() over (partition by source_id order by id desc) as n from jobs_v) select source_id, coalesce(max(case when n = 2 then id end), max(id)) as active_id from r group by 1",
    "replace_families": f"with p as (select id, source_id, {_PATTERN} as pattern from pages_v) select distinct source_id, pattern from p where id % 2 = 0 union all select distinct source_id, '/old' from p where source_id not in (select source_id from p where id % 2 = 0)",
    "refresh_plan": "select id, 'queued' as status, created_at from frontier_v where next_eligible_at is null or next_eligible_at <= timestamp '2024-01-08 02:00:00' order by created_at, id limit 500",
    "version_number": "select source_id, count(*) + 1 as next_version from jobs_v group by 1",
    "row_decisions": f"with {_ROWS}, e as (select event_id * 10 + 1 as row_id, arg_max(event_type, (ts, event_id)) as action from events group by 1) select id, case when is_draft then coalesce(action, status) else status end as status from w left join e on row_id = id",
    "source_profile": f"select source_id, count(*) as pages, count(distinct {_PATTERN}) as families, min(split_part(url, '://', 1)) as scheme from pages_v group by 1",
}.items()}
