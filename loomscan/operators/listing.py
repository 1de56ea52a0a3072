"""Filters, searches and listings: optional predicates, a total order, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.sources.views import view, with_views

AS_OF = "timestamp '2024-01-20 00:00:00'"
ACTIVITY = ("error", "purchase", "signup")


def keep(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None asks for nothing, a tuple for any of its values."""
    for name, value in equal.items():
        if isinstance(value, (tuple, list)):
            df = df.where(F.col(name).isin(*value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def text_match(columns: list[str], query: str | None) -> Column:
    """Case-insensitive match in any of the columns; % and _ in the query are wildcards."""
    out = F.lit(query is None)
    for c in columns if query is not None else ():
        out = out | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return out


def page(df: DataFrame, order: list[Column], limit: int | None = None, skip: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def list_records(records: DataFrame, search: str | None = None, skip: int = 0, limit: int | None = None, **equal) -> DataFrame:
    return page(keep(records, **equal).where(text_match(["title"], search)), [F.col("id")], limit, skip)


def search_filter(records: DataFrame, record_type: str | None = None, query: str | None = None, location: str | None = None, min_completeness: int | None = None, has_conflicts: bool | None = None, has_exhibitions: bool | None = None, has_articles: bool | None = None) -> DataFrame:
    """has_exhibitions and has_articles ask whether the payload (raw_data) names such a field; no payload fits neither answer."""
    found = keep(records, record_type=record_type, has_conflicts=has_conflicts).where(text_match(["title", "description", "nationality"], query)).where(text_match(["city", "nationality", "source_id"], location))
    for field, wanted in (("exhibitions", has_exhibitions), ("articles", has_articles)):
        if wanted is not None:
            found = found.where(F.contains("raw_data", F.lit(f'"{field}"')) == wanted)
    return found if min_completeness is None else found.where(F.col("completeness_score") >= min_completeness)


def with_exhibitions(records: DataFrame) -> DataFrame:
    """Adds exhibition_count, the entries of the payload's list (0 without one), and location, the places that are there."""
    n = F.coalesce(F.size(F.from_json("raw_data", "exhibitions array<string>")["exhibitions"]), F.lit(0))
    return records.withColumn("exhibition_count", F.greatest(F.lit(0), n)).withColumn("location", F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("nationality", F.lit(""))))


def search_artists(records: DataFrame, sort_by: str = "exhibitions", limit: int | None = None, skip: int = 0, **filters) -> DataFrame:
    """Artists under the search's filters with exhibition count and location, by that count or by a sort of the search."""
    if sort_by != "exhibitions":
        return with_exhibitions(search_records(records, sort_by, limit, skip, record_type="artist", **filters))
    return page(with_exhibitions(search_filter(records, record_type="artist", **filters)), [F.desc("exhibition_count"), F.col("id")], limit, skip)


def search_records(records: DataFrame, sort_by: str = "title", limit: int | None = None, skip: int = 0, **filters) -> DataFrame:
    order = {"title": F.asc_nulls_last("title"), "completeness": F.desc_nulls_last("completeness_score"), "updated": F.desc_nulls_last("updated_at")}[sort_by]
    return page(search_filter(records, **filters), [order, F.col("id")], limit, skip)


def count_search_records(records: DataFrame, **filters) -> DataFrame:
    return search_filter(records, **filters).agg(F.count("*").alias("total"))


def tenant_search(records: DataFrame, sources: DataFrame, tenant: str, query: str | None, limit: int, skip: int = 0) -> DataFrame:
    """Records of a tenant's sources with the total; page size clamped to 1..100."""
    own = sources.where(F.col("tenant") == tenant).select(F.col("source_id"))
    found = records.join(own, "source_id", "left_semi").where(text_match(["title"], query))
    total = found.agg(F.count("*").alias("total"))
    return page(found.crossJoin(total), [F.col("id")], max(1, min(100, limit)), skip)


def tenant_graph(edges: DataFrame, sources: DataFrame, tenant: str, node: int) -> DataFrame:
    own = sources.where(F.col("tenant") == tenant).select(F.col("id").alias("to_id"))
    return edges.where((F.col("from_id") == node) | (F.col("to_id") == node)).join(own, "to_id", "left_semi")


def list_logs(logs: DataFrame, search: str | None = None, ids: tuple[str, ...] = (), since: str | None = None, until: str | None = None, limit: int | None = None, skip: int = 0, **equal) -> DataFrame:
    """Logs newest first with the total before paging: equal columns (level, service, source), text in message or context, every id (job, worker, stage) in the context."""
    found = keep(logs, **equal).where(text_match(["message", "context"], search))
    for i in ids:
        found = found.where(text_match(["context"], i))
    if since:
        found = found.where(F.col("ts") >= F.expr(since))
    if until:
        found = found.where(F.col("ts") <= F.expr(until))
    total = found.agg(F.count("*").alias("total"))
    return page(found.crossJoin(total), [F.desc("ts"), F.desc("id")], limit, skip)


def activity_feed(logs: DataFrame, words: tuple[str, ...] = ACTIVITY, limit: int = 50) -> DataFrame:
    return page(logs.where(F.col("message").rlike("|".join(words))), [F.desc("ts"), F.desc("id")], limit)


def purge_logs(logs: DataFrame, as_of: str, days: int, level: str | None = None) -> DataFrame:
    """What is left after logs older than days (of one level) are gone."""
    old = F.col("ts") < F.expr(f"{as_of} - interval '{days}' day")
    return logs.where(~(old & (F.lit(True) if level is None else F.col("level") == level)))


def list_audit_events(events: DataFrame, level: str | None, date_from: str, date_to: str, search: str | None = None) -> DataFrame:
    """Dates are inclusive: the end is widened to the end of its day."""
    found = keep(events, level=level).where((F.col("ts") >= F.to_timestamp(F.lit(date_from))) & (F.col("ts") < F.date_add(F.to_date(F.lit(date_to)), 1).cast("timestamp")))
    return page(found.where(text_match(["message", "service", "context", "level"], search)), [F.desc("ts"), F.desc("id")])


def list_repair_proposals(proposals: DataFrame, limit: int) -> DataFrame:
    return page(proposals, [F.desc("priority"), F.desc("occurrences"), F.asc("created_at"), F.asc("id")], limit)


def list_jobs(jobs: DataFrame, sources: DataFrame, as_of: str, stale_minutes: int = 2) -> DataFrame:
    """Jobs with the source's name, figures of the JSON result, minutes between creation and heartbeat, percent done, and whether a running one went silent.

    The result may hold processed and total; percent is 100 for a done job, else their share, 0 without a total.
    """
    named = jobs.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")
    minutes = ((F.unix_timestamp("heartbeat_at") - F.unix_timestamp("created_at")) / 60).cast("int")
    stale = (F.col("status") == "running") & (F.col("heartbeat_at") < F.expr(f"{as_of} - interval '{stale_minutes}' minute"))
    figure = lambda name: F.get_json_object("result", f"$.{name}").try_cast("bigint")
    share = F.floor(100 * figure("processed") / F.nullif(figure("total"), F.lit(0))).cast("int")
    percent = F.when(F.col("status").isin("done", "completed"), 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(share, F.lit(0)))))
    return named.select("id", "source_id", "source_name", "status", figure("processed").alias("processed"), figure("total").alias("total"), percent.alias("percent"), minutes.alias("minutes"), stale.alias("stale"))


def newest_ascending(events: DataFrame, before: str, limit: int, **equal) -> DataFrame:
    """The newest rows before a cursor, returned oldest first."""
    return page(keep(events, **equal).where(F.col("ts") < F.expr(before)), [F.desc("ts"), F.desc("id")], limit).orderBy("ts", "id")


def review_queue(records: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """The queues conflicts and completeness (pending records), duplicates (pending reviews with both titles, by score) and recent (all records, priority 1).

    A record's priority is 100 less its completeness, 1 at least; a limit holds for each queue.
    """
    titles = lambda side: records.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"))
    rows = records.withColumn("priority", F.greatest(F.lit(1), 100 - F.coalesce("completeness_score", F.lit(0)))).withColumn("left_title", F.col("title")).withColumn("right_title", F.lit(None).cast("string"))
    pending = rows.where("status = 'pending'")
    twice = reviews.where("status = 'pending'").withColumn("priority", F.col("score")).join(titles("left"), "left_id", "left").join(titles("right"), "right_id", "left")
    queues = {
        "conflicts": (pending.where("has_conflicts"), [F.desc("priority"), F.desc("updated_at"), F.asc("id")]), "completeness": (pending, [F.desc("priority"), F.desc("updated_at"), F.asc("id")]),
        "duplicates": (twice, [F.desc("priority"), F.asc("id")]), "recent": (rows.withColumn("priority", F.lit(1)), [F.desc("updated_at"), F.asc("id")]),
    }
    out = None
    for name, (df, order) in queues.items():
        df = df if limit is None else page(df, order, limit)
        one = df.select(F.lit(name).alias("queue"), "id", "priority", "left_title", "right_title")
        out = one if out is None else out.unionByName(one)
    return out


def entity_conflicts(entities: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, entity_type, name, conflict): a row for each conflict of the canonical data's list; data that is no JSON or holds no list has none."""
    found = entities.withColumn("_c", F.from_json("canonical_data", "conflicts array<string>")["conflicts"]).where(F.size("_c") > 0)
    found = found if limit is None else page(found, [F.desc("updated_at"), F.col("id")], limit)
    return found.select("id", "entity_type", "name", F.explode("_c").alias("conflict"))


def bulk_approve(records: DataFrame, min_confidence: int) -> DataFrame:
    return records.withColumn("status", F.when((F.col("status") == "pending") & (F.col("confidence_score") >= min_confidence), "approved").otherwise(F.col("status")))


def find_incomplete(records: DataFrame, low: int, high: int, required: list[str], limit: int | None = None) -> DataFrame:
    """Records with a URL, completeness between the bounds, and all required fields missing, worst first."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.trim(F.col(c)) != "", F.lit(False)), c) for c in ("title", "description", "nationality", "city")]))
    rows = records.where(F.col("completeness_score").between(low, high) & (F.col("status") != "rejected") & F.col("url").isNotNull())
    return page(rows.where(F.size(F.array_except(F.array(*map(F.lit, required)), missing)) == 0), [F.col("completeness_score"), F.col("id")], limit)


def find_stale(records: DataFrame, as_of: str, days: int, limit: int | None = None) -> DataFrame:
    return page(records.where(F.col("updated_at") < F.expr(f"{as_of} - interval '{days}' day")), [F.col("updated_at"), F.col("id")], limit)


def url_ignore(urls: DataFrame, hints: list[str]) -> DataFrame:
    """URLs that hold none of the hints, as they stand."""
    for hint in hints:
        urls = urls.where(~F.contains("url", F.lit(hint)))
    return urls


def path_rules(urls: DataFrame, allowed: list[str], blocked: list[str]) -> DataFrame:
    starts = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("path"), p))
    out = urls.where(starts(allowed)) if allowed else urls
    return out.where(~starts(blocked)) if blocked else out


def _q(table, make):
    return lambda spark, sf_dir: make(view(spark, sf_dir, table))


def _q2(one, two, make):
    return lambda spark, sf_dir: make(view(spark, sf_dir, one), view(spark, sf_dir, two))


_R = ["id", "source_id", "record_type", "title", "status", "confidence_score", "completeness_score"]
_r = ", ".join(_R)


def _tenants(sources):
    return sources.select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_id"), "tenant")


def _proposals(signals):
    return signals.select("id", "source_id", (F.col("id") % 10).alias("priority"), (F.col("id") % 4).alias("occurrences"), F.col("detected_at").alias("created_at"))


QUERIES = {
    "list_records": _q("records_v", lambda r: list_records(r, search="the", status=("approved", "pending"), record_type="artist").select(*_R)),
    "search_records": _q("records_v", lambda r: search_records(r, query="the", location="src1", min_completeness=20, has_exhibitions=True, sort_by="completeness").select(*_R)),
    "count_search_records": _q("records_v", lambda r: count_search_records(r, query="the", location="src1", min_completeness=20, has_articles=False)),
    "search_artists": _q("records_v", lambda r: search_artists(r, has_articles=True, min_completeness=5).select(*_R, "exhibition_count", "location")),
    "search_exhibitions": _q("records_v", lambda r: search_records(r, record_type="exhibition", location="src", sort_by="title").select("id", "title", "city")),
    "search_articles": _q("records_v", lambda r: search_records(r, record_type="artwork", query="en", sort_by="updated", limit=300).select("id", "title")),
    "tenant_search": _q2("records_v", "sources_v", lambda r, s: tenant_search(r, _tenants(s), "AFRICA", "th", 100).select("id", "title", "total")),
    "tenant_export": _q2("records_v", "sources_v", lambda r, s: r.join(_tenants(s).where("tenant = 'ASIA'"), "source_id", "left_semi").where("status = 'approved'").select(*_R)),
    "tenant_graph": _q2("edges_v", "sources_v", lambda e, s: tenant_graph(e, s, "ASIA", 7).select("from_id", "to_id", "edge_type", "record_id", "line")),
    "list_pages": _q("pages_v", lambda p: page(keep(p, status=("fetched", "error")), [F.col("id")]).select("id", "source_id", "url", "status")),
    "list_logs": _q("log_v", lambda x: list_logs(x, level="error", search="1", ids=("k",), since="timestamp '2024-01-05 00:00:00'", until="timestamp '2024-01-25 00:00:00'").select("id", "ts", "message", "total")),
    "activity_feed": _q("log_v", lambda x: activity_feed(x).select("id", "message")),
    "purge_logs": _q("log_v", lambda x: purge_logs(x, AS_OF, 10, "debug").select("id", "level", "ts")),
    "list_audit_events": _q("log_v", lambda x: list_audit_events(x, None, "2024-01-03", "2024-01-05", "u1").select("id", "ts", "service")),
    "list_drift_signals": _q("signals_v", lambda x: page(keep(x, status="open", severity=("high", "medium")), [F.desc("detected_at"), F.desc("id")]).select("id", "signal_type", "severity", "detected_at")),
    "list_repair_proposals": _q("signals_v", lambda x: list_repair_proposals(_proposals(x), 500)),
    "list_images": _q("pages_v", lambda p: page(p, [F.col("id")]).select("id", F.col("source_id"), (F.col("id") % 3 == 0).alias("is_valid")).where("is_valid")),
    "list_jobs": _q2("jobs_v", "sources_v", lambda j, s: list_jobs(j.withColumn("result", F.to_json(F.struct((F.col("items") % 97).alias("processed"), F.when(F.col("id") % 3 > 0, F.col("items") % 89).alias("total")))), s, "timestamp '2024-01-01 00:00:00'")),
    "list_job_events": _q("log_v", lambda x: newest_ascending(x, AS_OF, 100, source_id=7).select("id", "ts", "level")),
    "list_source_events": _q("log_v", lambda x: newest_ascending(x, AS_OF, 200, level="error").select("id", "ts", "source_id")),
    "list_entities": _q("entities_v", lambda x: page(keep(x, entity_type="STANDARD"), [F.desc("id")]).select("id", "name")),
    "entity_conflicts": _q("entities_v", lambda e: entity_conflicts(e.withColumn("canonical_data", F.when(F.col("id") % 4 == 0, "none").when(F.col("id") % 4 == 1, '{"conflicts": []}').when(F.col("id") % 4 == 2, F.concat(F.lit('{"conflicts": ["name", "'), "city", F.lit('"]}')))))),
    "review_artists": _q("records_v", lambda r: r.where("record_type = 'artist' and completeness_score < 60 and (city is null or city = '')").select("id", "completeness_score")),
    "review_queue": _q2("records_v", "reviews_v", lambda r, v: review_queue(r.withColumn("has_conflicts", F.col("id") % 3 == 0), v)),
    "bulk_approve": _q("records_v", lambda r: bulk_approve(r, 60).select("id", "status")),
    "find_incomplete_records": _q("records_v", lambda r: find_incomplete(r, 5, 70, ["city"]).select("id", "completeness_score")),
    "find_records_by_source": _q("records_v", lambda r: list_records(r, source_id="src3").select("id", "record_type")),
    "find_stale_records": _q("records_v", lambda r: find_stale(r, "timestamp '2024-01-08 02:00:00'", 7).select("id", "updated_at")),
    "list_mapping_rows": _q2("edges_v", "entities_v", lambda e, x: e.join(x, e["from_id"] == x["id"]).where(e["confidence"] >= 0.95).where(F.col("entity_type") == "PROMO").select("record_id", "line", "name", "edge_type")),
    "crawl_run_listing": _q("frontier_v", lambda f: page(keep(f, status=("queued", "failed_retryable")), [F.desc("created_at"), F.desc("id")]).select("id", "status", "created_at")),
    "url_ignore_filter": _q("pages_v", lambda p: url_ignore(p, ["utm_", "/tag/", "/en/1"]).select("id", "url")),
    "path_rule_filter": _q("pages_v", lambda p: path_rules(p, ["/en/", "/fr/"], ["/en/1"]).select("id", "path")),
    "list_mappings": _q2("jobs_v", "sources_v", lambda j, s: j.join(s.select(F.col("id").alias("source_id"), "name", "url"), "source_id").select("id", "name", "url", "created_at")),
    "list_versions": _q("jobs_v", lambda j: page(keep(j, source_id=11), [F.desc("created_at"), F.desc("id")]).select("id", "created_at")),
    "edges_for_entity": _q("edges_v", lambda e: e.where("from_id = 5 or to_id = 5").select("from_id", "to_id", "record_id", "line")),
    "list_campaigns": _q("jobs_v", lambda j: page(j.groupBy("source_id").agg(F.count("*").alias("jobs"), F.min("items").alias("before_items"), F.max("items").alias("after_items"), F.max("created_at").alias("latest")), [F.desc("latest"), F.asc("source_id")])),
}

_LIKE = lambda cols, q: "(" + " or ".join(f"coalesce({c} ilike '%{q}%', false)" for c in cols) + ")"
_SEARCH = f"{_LIKE(['title', 'description', 'nationality'], 'the')} and {_LIKE(['city', 'nationality', 'source_id'], 'src1')} and completeness_score >= 20"

ORACLE = {k: with_views(v) for k, v in {
    "list_records": f"select {_r} from records_v where status in ('approved', 'pending') and record_type = 'artist' and title ilike '%the%'",
    "search_records": f"select {_r} from records_v where {_SEARCH} and id % 5 < 3",
    "count_search_records": f"select count(*) as total from records_v where {_SEARCH} and id % 3 <> 0",
    "search_artists": f"select {_r}, case id % 5 when 1 then 1 when 2 then 3 else 0 end as exhibition_count, concat_ws(', ', nullif(city, ''), nullif(nationality, '')) as location from records_v where record_type = 'artist' and completeness_score >= 5 and id % 3 = 0",
    "search_exhibitions": f"select id, title, city from records_v where record_type = 'exhibition' and {_LIKE(['city', 'nationality', 'source_id'], 'src')}",
    "search_articles": f"select id, title from records_v where record_type = 'artwork' and {_LIKE(['title', 'description', 'nationality'], 'en')} order by updated_at desc, id limit 300",
    "tenant_search": "with f as (select id, title from records_v where source_id in (select 'src' || id from sources_v where tenant = 'AFRICA') and title ilike '%th%') select id, title, (select count(*) from f) as total from f order by id limit 100",
    "tenant_export": f"select {_r} from records_v where status = 'approved' and source_id in (select 'src' || id from sources_v where tenant = 'ASIA')",
    "tenant_graph": "select from_id, to_id, edge_type, record_id, line from edges_v where (from_id = 7 or to_id = 7) and to_id in (select id from sources_v where tenant = 'ASIA')",
    "list_pages": "select id, source_id, url, status from pages_v where status in ('fetched', 'error')",
    "list_logs": "select id, ts, message, count(*) over () as total from log_v where level = 'error' and (message ilike '%1%' or context ilike '%1%') and context ilike '%k%' and ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-25 00:00:00'",
    "activity_feed": "select id, message from log_v where regexp_matches(message, 'error|purchase|signup') order by ts desc, id desc limit 50",
    "purge_logs": f"select id, level, ts from log_v where not (ts < {AS_OF} - interval '10' day and level = 'debug')",
    "list_audit_events": "select id, ts, service from log_v where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-06' and (message ilike '%u1%' or service ilike '%u1%' or context ilike '%u1%' or level ilike '%u1%')",
    "list_drift_signals": "select id, signal_type, severity, detected_at from signals_v where status = 'open' and severity in ('high', 'medium')",
    "list_repair_proposals": "select id, source_id, id % 10 as priority, id % 4 as occurrences, detected_at as created_at from signals_v order by 3 desc, 4 desc, 5, 1 limit 500",
    "list_images": "select id, source_id, true as is_valid from pages_v where id % 3 = 0",
    "list_jobs": "with j as (select *, items % 97 as processed, case when id % 3 > 0 then items % 89 end as total from jobs_v) select j.id, source_id, s.name as source_name, j.status, processed, total, case when j.status = 'done' then 100 else least(100, coalesce(cast(floor(100 * processed / nullif(total, 0)) as int), 0)) end as percent, cast(date_diff('second', created_at, heartbeat_at) / 60 as int) as minutes, j.status = 'running' and heartbeat_at < timestamp '2024-01-01 00:00:00' - interval '2' minute as stale from j left join sources_v s on s.id = source_id",
    "list_job_events": f"select id, ts, level from log_v where source_id = 7 and ts < {AS_OF} order by ts desc, id desc limit 100",
    "list_source_events": f"select id, ts, source_id from log_v where level = 'error' and ts < {AS_OF} order by ts desc, id desc limit 200",
    "list_entities": "select id, name from entities_v where entity_type = 'STANDARD'",
    "entity_conflicts": "select id, entity_type, name, unnest(['name', city]) as conflict from entities_v where id % 4 = 2",
    "review_artists": "select id, completeness_score from records_v where record_type = 'artist' and completeness_score < 60 and (city is null or city = '')",
    "review_queue": "with q as (select *, greatest(1, 100 - completeness_score) as priority from records_v) select 'conflicts' as queue, id, priority, title as left_title, null::varchar as right_title from q where id % 3 = 0 and status = 'pending' union all select 'completeness', id, priority, title, null from q where status = 'pending' union all select 'recent', id, 1, title, null from q union all select 'duplicates', v.id, v.score, a.title, b.title from reviews_v v left join records_v a on a.id = v.left_id left join records_v b on b.id = v.right_id where v.status = 'pending'",
    "bulk_approve": "select id, case when status = 'pending' and confidence_score >= 60 then 'approved' else status end as status from records_v",
    "find_incomplete_records": "select id, completeness_score from records_v where completeness_score between 5 and 70 and status <> 'rejected' and url is not null and coalesce(trim(city), '') = ''",
    "find_records_by_source": "select id, record_type from records_v where source_id = 'src3'",
    "find_stale_records": "select id, updated_at from records_v where updated_at < timestamp '2024-01-01 02:00:00'",
    "list_mapping_rows": "select record_id, line, name, edge_type from edges_v e join entities_v x on e.from_id = x.id where e.confidence >= 0.95 and entity_type = 'PROMO'",
    "crawl_run_listing": "select id, status, created_at from frontier_v where status in ('queued', 'failed_retryable')",
    "url_ignore_filter": "select id, url from pages_v where not (contains(url, 'utm_') or contains(url, '/tag/') or contains(url, '/en/1'))",
    "path_rule_filter": "select id, path from pages_v where (starts_with(path, '/en/') or starts_with(path, '/fr/')) and not starts_with(path, '/en/1')",
    "list_mappings": "select j.id, name, url, created_at from jobs_v j join sources_v s on s.id = j.source_id",
    "list_versions": "select id, created_at from jobs_v where source_id = 11",
    "edges_for_entity": "select from_id, to_id, record_id, line from edges_v where from_id = 5 or to_id = 5",
    "list_campaigns": "select source_id, count(*) as jobs, min(items) as before_items, max(items) as after_items, max(created_at) as latest from jobs_v group by 1",
}.items()}
