"""Aggregations and reports: one pass and one grouping each, conditional counts in place of repeated scans."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.sources.views import view, with_views

#: Record types and bands of the totals, states of a source at work, of a waiting and an active job, of a resumable run.
TYPES = ("artist", "event", "exhibition", "venue", "artwork")
BANDS = ("HIGH", "MEDIUM", "LOW")
AT_WORK = ("mapping", "crawling", "extracting")
WAITING = ("queued", "pending")
ACTIVE = ("queued", "pending", "running", "paused")
RESUMABLE = ("paused", "failed", "stale", "cooling_down")
COUNTERS = ("records_created", "records_updated", "deterministic_hits", "deterministic_misses", "media_assets_captured", "entity_links_created")


def counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Conditional counts by group, or over the whole table without a group."""
    out = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def daily(df: DataFrame, ts: str, first: str, last: str, **measures: Column) -> DataFrame:
    """A row for each day from first to last, 0 where a day has no rows."""
    days = df.sparkSession.sql(f"select explode(sequence(date '{first}', date '{last}', interval '1' day)) as day")
    per = df.groupBy(F.to_date(ts).alias("day")).agg(*[m.alias(n) for n, m in measures.items()])
    return days.join(per, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), digits)


def mapping_health(signals: DataFrame) -> DataFrame:
    """stale with any high or three live signals, warning with a medium one, else healthy."""
    live = F.col("status").isin("open", "acknowledged")
    c = counts(signals, ["source_id"], high=live & (F.col("severity") == "high"), medium=live & (F.col("severity") == "medium"), live=live)
    return c.select("source_id", F.when((F.col("high") > 0) | (F.col("live") >= 3), "stale").when(F.col("medium") > 0, "warning").otherwise("healthy").alias("health"))


def cost_report(calls: DataFrame, prices: DataFrame, limit: float = 0.15) -> DataFrame:
    """Tokens and cost by model, operation and day; over: cost above the limit."""
    cost = F.col("n_in") * F.col("price_in") / 1e6 + F.col("n_out") * F.col("price_out") / 1e6
    g = calls.join(prices, "model").groupBy("model", "operation", F.to_date("ts").alias("day")).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.round(F.sum(cost), 6).alias("cost"))
    return g.withColumn("over", F.col("cost") > limit)


def edge_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges per node, over edges with both ends among the nodes."""
    inside = edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return inside.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def _calls(x):
    return x.select("ts", F.col("level").alias("operation"), F.when(F.col("id") % 2 == 0, "small").otherwise("large").alias("model"), (F.col("id") % 5000).alias("n_in"), (F.col("id") % 700).alias("n_out"))


def equals(column: str, values: tuple[str, ...]) -> dict[str, Column]:
    """A condition for each value, named by it in lower case."""
    return {v.lower(): F.col(column) == v for v in values}


def global_stats(records: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of totals: sources by state, records by status, type and band, pages by state; one pass over each table."""
    r = counts(records, [], records=F.lit(True), **equals("status", ("pending", "approved", "rejected", "exported")), **equals("record_type", TYPES), **equals("confidence_band", BANDS))
    p = counts(pages, [], pages=F.lit(True), crawled=F.col("status").isin("fetched", "classified", "extracted"), error=F.col("status") == "error")
    return r.crossJoin(p).crossJoin(counts(sources, [], sources=F.lit(True), active=F.col("status").isin(*AT_WORK), done=F.col("status") == "done"))


def platform_metrics(records: DataFrame, pages: DataFrame, reviews: DataFrame, actions: DataFrame, merge: str = "merge") -> DataFrame:
    """One row: artists and their mean completeness, conflicts, records with any completeness, pages, duplicate reviews, merge actions."""
    artist = F.col("record_type") == "artist"
    r = records.agg(F.count_if(artist).alias("artists"), F.round(F.coalesce(F.avg(F.when(artist, F.col("completeness_score"))), F.lit(0.0)), 2).alias("mean_completeness"), F.count_if("has_conflicts").alias("conflicts"), F.count_if(F.col("completeness_score") > 0).alias("enriched"))
    return r.crossJoin(counts(pages, [], pages=F.lit(True))).crossJoin(counts(reviews, [], duplicates=F.lit(True))).crossJoin(counts(actions, [], merges=F.col("action") == merge))


def metrics_history(records: DataFrame, reviews: DataFrame, crawls: DataFrame, merges: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day: records created (by created_at), mean completeness (by updated_at), reviews, merges, share of crawls that ended well; 0 where a day has none."""
    def told(df: DataFrame, ts: str, kind: str, value: Column = F.lit(None)) -> DataFrame:
        return df.select(F.col(ts).alias("ts"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))

    ended_well = F.col("status").isin("done", "completed").cast("int")
    parts = [told(records, "created_at", "created"), told(records, "updated_at", "updated", F.col("completeness_score")), told(reviews, "created_at", "review"), told(merges, "created_at", "merge"), told(crawls, "created_at", "crawl", F.coalesce(ended_well, F.lit(0)))]
    of = lambda kind: F.col("kind") == kind
    # all tables meet in one partial aggregate by day, instead of a join for each measure
    return daily(
        functools.reduce(DataFrame.unionByName, parts), "ts", first, last, records_created=F.count_if(of("created")), mean_completeness=F.round(F.avg(F.when(of("updated"), F.col("value"))), 2),
        duplicates=F.count_if(of("review")), merges=F.count_if(of("merge")), crawl_success=ratio(F.sum(F.when(of("crawl"), F.col("value"))), F.count_if(of("crawl"))),
    )


def filtered_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(name, n): rows of each table under its filter."""
    out = None
    for name, (df, condition) in tables.items():
        one = df.where(condition).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def mining_status(pages: DataFrame, records: DataFrame, images: DataFrame) -> DataFrame:
    """Per source with pages: pages by state, records by type, images, percent fetched; each table is grouped before it is joined."""
    p = counts(pages, ["source_id"], total=F.lit(True), **equals("status", ("fetched", "classified", "skipped", "error")))
    r = counts(records, ["source_id"], records=F.lit(True), **equals("record_type", TYPES))
    out = p.join(r, "source_id", "left").join(counts(images, ["source_id"], images=F.lit(True)), "source_id", "left").na.fill(0)
    return out.withColumn("eligible", F.col("fetched") + F.col("classified")).withColumn("percent", F.least(F.lit(100), F.floor(F.col("fetched") * 100 / F.col("total")).cast("int")))


def source_operations(jobs: DataFrame, moderation: DataFrame, recent: int = 10) -> DataFrame:
    """Per source with jobs: active jobs, ids of the most recent ones, newest first, rows that wait for moderation."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("created_at"), F.desc("id")))
    newest = jobs.select("source_id", "id", "created_at").withColumn("rank", rank).where(F.col("rank") <= recent)
    runs = newest.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("recent_runs"))
    out = counts(jobs, ["source_id"], active=F.col("status").isin(*ACTIVE)).join(runs, "source_id")
    return out.join(counts(moderation, ["source_id"], pending_moderation=F.lit(True)), "source_id", "left").na.fill(0, ["pending_moderation"])


def enrichment_summary(jobs: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per source: jobs of the types, and the sums of the counters in their JSON result; a missing or unreadable counter is 0."""
    value = lambda c: F.coalesce(F.get_json_object("result", f"$.{c}").try_cast("bigint"), F.lit(0))
    return jobs.where(F.col("job_type").isin(*types)).groupBy("source_id").agg(F.count("*").alias("runs"), *[F.sum(value(c)).alias(c) for c in COUNTERS])


def queue_summary(jobs: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One row: waiting, running and failed jobs, paused sources, and the age of the oldest waiting job in seconds, 0 at least."""
    age = F.unix_timestamp(F.expr(as_of)) - F.unix_timestamp("created_at")
    oldest = F.max(F.when(F.col("status").isin(*WAITING), age))
    j = jobs.agg(F.count_if(F.col("status").isin(*WAITING)).alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"), F.greatest(F.lit(0), F.coalesce(oldest, F.lit(0))).alias("oldest_seconds"))
    return j.crossJoin(counts(sources, [], paused=F.col("enabled") & F.col("queue_paused")))


def crawl_run_summary(frontier: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run (source_id, status): URLs by state, errors, the URL fetched last as checkpoint, and whether it can go on."""
    states = ("queued", "fetching", "fetched", "extracted", "skipped", "failed_terminal", "failed_retryable")
    done = F.when(F.col("status").isin("fetched", "extracted"), F.struct("created_at", "id", "url"))
    c = frontier.groupBy("source_id").agg(*[F.count_if(v).alias(k) for k, v in equals("status", states).items()], F.max(done)["url"].alias("last_url"))
    out = runs.join(c, "source_id", "left").na.fill(0, list(states))
    more = F.col("status").isin(*RESUMABLE) | (F.col("failed_retryable") > 0) | (F.col("queued") > 0)
    return out.withColumn("errors", F.col("failed_terminal") + F.col("failed_retryable")).drop("failed_terminal").withColumn("resumable", more)


def repair_feedback(proposals: DataFrame) -> DataFrame:
    """Per source and field: share of proposals validated or applied, and of applied ones known to have worked (0.5 without any)."""
    applied = F.col("status") == "APPLIED"
    worked = F.avg(F.when(applied, F.coalesce("worked", F.lit(False)).cast("double")))
    accepted = F.avg(F.coalesce(F.col("status").isin("VALIDATED", "APPLIED"), F.lit(False)).cast("double"))
    return proposals.groupBy("source_id", "field").agg(F.round(accepted, 4).alias("accepted_rate"), F.round(F.coalesce(worked, F.lit(0.5)), 4).alias("apply_success_rate"))


def _activity(s, d, *levels):
    return view(s, d, "log_v").where(F.col("level").isin(*levels)).select(F.col("ts").alias("created_at"), F.when(F.col("level") == "info", "done").when(F.col("level") == "debug", "completed").otherwise("failed").alias("status"))


def _moderation(s, d):
    """Unreviewed records, and pending duplicate reviews under the source of their left job."""
    jobs = view(s, d, "jobs_v").select(F.col("id").alias("left_id"), "source_id")
    return view(s, d, "records_v").where("status = 'pending'").select(F.col("id").alias("source_id")).union(view(s, d, "reviews_v").where("status = 'pending'").join(jobs, "left_id").select("source_id"))


def _results(s, d):
    k = F.get_json_object("context", "$.k").cast("bigint")
    return view(s, d, "log_v").select("source_id", F.col("level").alias("job_type"), F.to_json(F.struct(*[(k % (i + 2)).alias(c) for i, c in enumerate(COUNTERS) if c != "media_assets_captured"])).alias("result"))


def _counted(s, d):
    pages, records = view(s, d, "pages_v"), view(s, d, "records_v")
    return filtered_counts({
        "pages": (pages, F.col("status").isin("fetched", "error")), "records": (records, (F.col("record_type") == "artist") & (F.col("status") == "approved")), "images": (pages, F.col("id") % 3 == 0),
        "reviews": (view(s, d, "reviews_v"), F.col("status") == "pending"), "actions": (view(s, d, "log_v"), F.col("level") == "purchase"), "frontier": (view(s, d, "frontier_v"), F.col("skip_reason") == "robots"),
    })


def _mined(s, d):
    """Records under the host of the page of their id; an image for each third page."""
    pages = view(s, d, "pages_v")
    return mining_status(pages.withColumn("status", F.when(F.col("status") == "extracted", "classified").otherwise(F.col("status"))), view(s, d, "records_v").drop("source_id").join(pages.select("id", "source_id"), "id"), pages.where("id % 3 = 0"))


def _runs(s, d):
    return view(s, d, "pages_v").groupBy("source_id").agg(F.when(F.count("*") % 2 == 0, "paused").otherwise("running").alias("status"))


def proposals_of(signals: DataFrame) -> DataFrame:
    """Signals read as repair proposals: acknowledged ones are validated, resolved ones applied, low ones worked."""
    return signals.select("source_id", "field", F.when(F.col("status") == "acknowledged", "VALIDATED").when(F.col("status") == "resolved", "APPLIED").otherwise("PROPOSED").alias("status"), (F.col("severity") == "low").alias("worked"))


QUERIES = {
    "source_stats": lambda s, d: counts(view(s, d, "records_v"), ["source_id"], approved=F.col("status") == "approved", rejected=F.col("status") == "rejected", pending=F.col("status") == "pending", high=F.col("confidence_band") == "HIGH", medium=F.col("confidence_band") == "MEDIUM", low=F.col("confidence_band") == "LOW"),
    "global_stats": lambda s, d: global_stats(view(s, d, "records_v"), view(s, d, "pages_v"), view(s, d, "sources_v")),
    "platform_metrics": lambda s, d: platform_metrics(view(s, d, "records_v"), view(s, d, "pages_v"), view(s, d, "reviews_v"), view(s, d, "log_v").withColumnRenamed("level", "action"), "purchase"),
    "metrics_history": lambda s, d: metrics_history(view(s, d, "records_v").withColumn("created_at", F.expr("updated_at - interval '12' hour")), _activity(s, d, "signup"), _activity(s, d, "info", "debug", "error"), _activity(s, d, "purchase"), "2023-12-25", "2024-02-02"),
    "metric_snapshots": lambda s, d: daily(view(s, d, "log_v"), "ts", "2024-01-01", "2024-01-30", events=F.count("*")).where("day >= date '2024-01-10'").orderBy(F.desc("day")).limit(10),
    "count_by": lambda s, d: count_by(view(s, d, "records_v"), "record_type", "status"),
    "filtered_counts": _counted,
    "usage_summary": lambda s, d: view(s, d, "log_v").groupBy(F.col("level").alias("endpoint")).agg(F.count("*").alias("requests"), F.round(F.avg("value"), 4).alias("mean_ms")).orderBy(F.desc("requests"), "endpoint"),
    "mining_status": _mined,
    "source_operations": lambda s, d: source_operations(view(s, d, "jobs_v"), _moderation(s, d)),
    "enrichment_summary": lambda s, d: enrichment_summary(_results(s, d), ("signup", "purchase", "error")),
    "queue_summary": lambda s, d: queue_summary(view(s, d, "jobs_v"), view(s, d, "sources_v").withColumn("queue_paused", F.col("id") % 3 == 0), "timestamp '2024-01-20 00:00:00'"),
    "crawl_run_summary": lambda s, d: crawl_run_summary(view(s, d, "frontier_v"), _runs(s, d)),
    "export_preview": lambda s, d: view(s, d, "records_v").where("status = 'approved' and not has_conflicts").groupBy("record_type").agg(F.count("*").alias("exportable")),
    "campaign_progress": lambda s, d: counts(view(s, d, "jobs_v"), ["job_type"], pending=F.col("status") == "pending", completed=F.col("status") == "done", running=F.col("status") == "running").withColumn("complete", (F.col("pending") + F.col("running")) == 0),
    "campaign_plan": lambda s, d: view(s, d, "records_v").where("completeness_score between 10 and 60 and url is not null").select(F.col("id").alias("record_id"), F.col("completeness_score").alias("before_score"), F.lit(True).alias("dry_run")),
    "llm_cost_report": lambda s, d: cost_report(_calls(view(s, d, "log_v")), s.createDataFrame([("small", 0.5, 1.5), ("large", 10.0, 30.0)], "model string, price_in double, price_out double")),
    "drift_fields": lambda s, d: count_by(view(s, d, "signals_v"), "field").orderBy(F.desc("n"), "field"),
    "mapping_health": lambda s, d: mapping_health(view(s, d, "signals_v")),
    "repair_feedback": lambda s, d: repair_feedback(proposals_of(view(s, d, "signals_v"))),
    "refresh_eligibility": lambda s, d: counts(view(s, d, "frontier_v"), [], total=F.lit(True), due=F.col("next_eligible_at").isNull() | (F.col("next_eligible_at") <= F.expr("timestamp '2024-01-08 02:00:00'"))).withColumn("not_due", F.col("total") - F.col("due")),
    "enrichment_rollup": lambda s, d: view(s, d, "records_v").groupBy("record_type").agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "approved").alias("enriched"), F.round(F.avg("completeness_score"), 2).alias("mean_completeness")),
    "extraction_success_rate": lambda s, d: view(s, d, "pages_v").groupBy("source_id").agg(F.round(F.count_if(F.col("status").isin("fetched", "extracted")) * 100 / F.count("*"), 2).alias("rate")).withColumn("passed", F.col("rate") >= 85),
    "edge_degree": lambda s, d: edge_degree(view(s, d, "edges_v"), view(s, d, "entities_v")),
}

_D = "date '2023-12-25' + cast(unnest(range(40)) as int)"
ORACLE = {k: with_views(v) for k, v in {
    "source_stats": "select source_id, count_if(status = 'approved') as approved, count_if(status = 'rejected') as rejected, count_if(status = 'pending') as pending, count_if(confidence_band = 'HIGH') as high, count_if(confidence_band = 'MEDIUM') as medium, count_if(confidence_band = 'LOW') as low from records_v group by 1",
    "global_stats": "select (select count(*) from records_v) as records, (select count(*) from records_v where status = 'pending') as pending, (select count(*) from records_v where status = 'approved') as approved, (select count(*) from records_v where status = 'rejected') as rejected, (select count(*) from records_v where status = 'exported') as exported, (select count(*) from records_v where record_type = 'artist') as artist, (select count(*) from records_v where record_type = 'event') as event, (select count(*) from records_v where record_type = 'exhibition') as exhibition, (select count(*) from records_v where record_type = 'venue') as venue, (select count(*) from records_v where record_type = 'artwork') as artwork, (select count(*) from records_v where confidence_band = 'HIGH') as high, (select count(*) from records_v where confidence_band = 'MEDIUM') as medium, (select count(*) from records_v where confidence_band = 'LOW') as low, (select count(*) from pages_v) as pages, (select count(*) from pages_v where status in ('fetched', 'classified', 'extracted')) as crawled, (select count(*) from pages_v where status = 'error') as error, (select count(*) from sources_v) as sources, (select count(*) from sources_v where status in ('mapping', 'crawling', 'extracting')) as active, (select count(*) from sources_v where status = 'done') as done",
    "platform_metrics": "select (select count(*) from records_v where record_type = 'artist') as artists, (select coalesce(round(avg(completeness_score), 2), 0) from records_v where record_type = 'artist') as mean_completeness, (select count(*) from records_v where has_conflicts) as conflicts, (select count(*) from records_v where completeness_score > 0) as enriched, (select count(*) from pages_v) as pages, (select count(*) from reviews_v) as duplicates, (select count(*) from log_v where level = 'purchase') as merges",
    "metrics_history": f"with d as (select {_D} as day), l as (select cast(ts as date) as day, count_if(level = 'signup') as dup, count_if(level = 'purchase') as mer, round(count_if(level in ('info', 'debug')) / nullif(count_if(level in ('info', 'debug', 'error')), 0), 4) as ok from log_v group by 1), c as (select cast(updated_at - interval '12' hour as date) as day, count(*) as n from records_v group by 1), u as (select cast(updated_at as date) as day, round(avg(completeness_score), 2) as m from records_v group by 1) select d.day, coalesce(n, 0) as records_created, coalesce(m, 0) as mean_completeness, coalesce(dup, 0) as duplicates, coalesce(mer, 0) as merges, coalesce(ok, 0) as crawl_success from d left join l on l.day = d.day left join c on c.day = d.day left join u on u.day = d.day",
    "metric_snapshots": "with d as (select date '2024-01-01' + cast(unnest(range(30)) as int) as day), p as (select cast(ts as date) as day, count(*) as events from log_v group by 1) select d.day, coalesce(events, 0) as events from d left join p on p.day = d.day where d.day >= date '2024-01-10' order by 1 desc limit 10",
    "count_by": "select record_type, status, count(*) as n from records_v group by 1, 2",
    "filtered_counts": "select 'pages' as name, count(*) as n from pages_v where status in ('fetched', 'error') union all select 'records', count(*) from records_v where record_type = 'artist' and status = 'approved' union all select 'images', count(*) from pages_v where id % 3 = 0 union all select 'reviews', count(*) from reviews_v where status = 'pending' union all select 'actions', count(*) from log_v where level = 'purchase' union all select 'frontier', count(*) from frontier_v where skip_reason = 'robots'",
    "usage_summary": "select level as endpoint, count(*) as requests, round(avg(value), 4) as mean_ms from log_v group by 1",
    "mining_status": "with p as (select source_id, count(*) as total, count_if(status = 'fetched') as fetched, count_if(status = 'extracted') as classified, count_if(status = 'skipped') as skipped, count_if(status = 'error') as error, count_if(id % 3 = 0) as images from pages_v group by 1), r as (select p.source_id, count(*) as records, count_if(record_type = 'artist') as artist, count_if(record_type = 'event') as event, count_if(record_type = 'exhibition') as exhibition, count_if(record_type = 'venue') as venue, count_if(record_type = 'artwork') as artwork from records_v r join pages_v p on p.id = r.id group by 1) select p.*, coalesce(records, 0) as records, coalesce(artist, 0) as artist, coalesce(event, 0) as event, coalesce(exhibition, 0) as exhibition, coalesce(venue, 0) as venue, coalesce(artwork, 0) as artwork, fetched + classified as eligible, cast(least(100, floor(fetched * 100 / total)) as int) as percent from p left join r on r.source_id = p.source_id",
    "source_operations": "with m as (select id as source_id from records_v where status = 'pending' union all select source_id from reviews_v r join jobs_v j on j.id = r.left_id where r.status = 'pending'), n as (select source_id, count(*) as n from m group by 1), c as (select source_id, count_if(status in ('queued', 'pending', 'running', 'paused')) as active, array_to_string(list(id order by created_at desc, id desc)[1:10], ',') as recent_runs from jobs_v group by 1) select c.*, coalesce(n, 0) as pending_moderation from c left join n on n.source_id = c.source_id",
    "enrichment_summary": "with k as (select source_id, cast(context->>'$.k' as bigint) as k from log_v where level in ('signup', 'purchase', 'error')) select source_id, count(*) as runs, cast(coalesce(sum(k % 2), 0) as bigint) as records_created, cast(coalesce(sum(k % 3), 0) as bigint) as records_updated, cast(coalesce(sum(k % 4), 0) as bigint) as deterministic_hits, cast(coalesce(sum(k % 5), 0) as bigint) as deterministic_misses, 0::bigint as media_assets_captured, cast(coalesce(sum(k % 7), 0) as bigint) as entity_links_created from k group by 1",
    "queue_summary": "select count_if(status in ('queued', 'pending')) as pending, count_if(status = 'running') as running, count_if(status = 'failed') as failed, greatest(0, coalesce(max(case when status in ('queued', 'pending') then date_diff('second', cast(created_at as timestamp), timestamp '2024-01-20') end), 0)) as oldest_seconds, (select count(*) from sources_v where enabled and id % 3 = 0) as paused from jobs_v",
    "crawl_run_summary": "with r as (select source_id, case when count(*) % 2 = 0 then 'paused' else 'running' end as status from pages_v group by 1), c as (select source_id, count_if(status = 'queued') as queued, count_if(status = 'fetching') as fetching, count_if(status = 'fetched') as fetched, count_if(status = 'extracted') as extracted, count_if(status = 'skipped') as skipped, count_if(status = 'failed_retryable') as failed_retryable, count_if(status in ('failed_retryable', 'failed_terminal')) as errors, arg_max(url, (created_at, id)) filter (status in ('fetched', 'extracted')) as last_url from frontier_v group by 1) select c.*, r.status, r.status = 'paused' or failed_retryable > 0 or queued > 0 as resumable from r join c on c.source_id = r.source_id",
    "export_preview": "select record_type, count(*) as exportable from records_v where status = 'approved' and not has_conflicts group by 1",
    "campaign_progress": "with c as (select job_type, count_if(status = 'pending') as pending, count_if(status = 'done') as completed, count_if(status = 'running') as running from jobs_v group by 1) select *, pending + running = 0 as complete from c",
    "campaign_plan": "select id as record_id, completeness_score as before_score, true as dry_run from records_v where completeness_score between 10 and 60 and url is not null",
    "llm_cost_report": "with c as (select case when id % 2 = 0 then 'small' else 'large' end as model, level as operation, cast(ts as date) as day, id % 5000 as i, id % 700 as o from log_v), g as (select model, operation, day, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out from c group by 1, 2, 3), h as (select *, round(n_in * case model when 'small' then 0.5 else 10.0 end::double / 1e6 + n_out * case model when 'small' then 1.5 else 30.0 end::double / 1e6, 6) as cost from g) select *, cost > 0.15 as over from h",
    "drift_fields": "select field, count(*) as n from signals_v group by 1",
    "mapping_health": "with c as (select source_id, count_if(status <> 'resolved' and severity = 'high') as h, count_if(status <> 'resolved' and severity = 'medium') as m, count_if(status <> 'resolved') as l from signals_v group by 1) select source_id, case when h > 0 or l >= 3 then 'stale' when m > 0 then 'warning' else 'healthy' end as health from c",
    "repair_feedback": "select source_id, field, round(count_if(status <> 'open') / count(*), 4) as accepted_rate, round(coalesce(count_if(status = 'resolved' and severity = 'low') / nullif(count_if(status = 'resolved'), 0), 0.5), 4) as apply_success_rate from signals_v group by 1, 2",
    "refresh_eligibility": "with c as (select count(*) as total, count_if(next_eligible_at is null or next_eligible_at <= timestamp '2024-01-08 02:00:00') as due from frontier_v) select total, due, total - due as not_due from c",
    "enrichment_rollup": "select record_type, count(*) as processed, count_if(status = 'approved') as enriched, round(avg(completeness_score), 2) as mean_completeness from records_v group by 1",
    "extraction_success_rate": "with c as (select source_id, round(count_if(status in ('fetched', 'extracted')) * 100 / count(*), 2) as rate from pages_v group by 1) select *, rate >= 85 as passed from c",
    "edge_degree": "with e as (select from_id, to_id from edges_v where from_id in (select id from entities_v) and to_id in (select id from entities_v)), u as (select from_id as id from e union all select to_id from e) select id, count(*) as degree from u group by 1",
}.items()}
