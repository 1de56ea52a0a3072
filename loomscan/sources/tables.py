"""Sources and sinks: typed loads, page ingest, feeds, CSV, log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.functions import urls as U
from loomscan.sources.views import view, with_views

HTML_CHARS = 500 * 1024


#: Schemas of the base tables, so that no footer has to be read for them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string",
}
LEVELS = ("debug", "info", "warning", "error")


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table, with a schema if one is given so that no footer has to be read for it."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def ingest_pages(raw: DataFrame) -> DataFrame:
    """Raw rows (id, url, html) to page rows: no NUL, at most 500 Ki characters, content hash, title, host, normalised URL."""
    html = F.substring(F.translate("html", "\x00", ""), 1, HTML_CHARS)
    return raw.select("id", U.normalize_url(F.col("url")).alias("url"), U.host(F.col("url")).alias("host"), F.sha2(html, 256).alias("content_hash"), F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"), F.length(html).alias("chars"))


def export_feed(records: DataFrame, images: DataFrame) -> DataFrame:
    """A row per record with its valid images nested in order, the primary one, and its confidence as (score, band); empty texts are null."""
    per = images.where("is_valid").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "image_url"))).alias("images"), F.min_by("image_url", "image_id").alias("primary_image"))
    return records.join(per, records["id"] == per["record_id"], "left").select("id", "record_type", F.nullif(F.trim("title"), F.lit("")).alias("title"), F.nullif(F.trim("city"), F.lit("")).alias("city"), "images", "primary_image", F.struct(F.col("confidence_score").alias("score"), F.col("confidence_band").alias("band")).alias("confidence"))


def export_artists(records: DataFrame, provenance: bool = False) -> DataFrame:
    """Artists with the first value that is there of column and payload, the payload's exhibitions and articles (empty lists without them), and where it came from if asked.

    A payload that is no JSON counts as empty.
    """
    kind = "name string, city string, exhibitions array<string>, articles array<string>, provenance map<string,string>, artist_payload_provenance map<string,string>"
    p = records.where("record_type = 'artist'").withColumn("_p", F.from_json("raw_data", kind))
    listed = lambda c: F.coalesce(F.col(f"_p.{c}"), F.array().cast("array<string>")).alias(c)
    out = [F.col("id"), first_of("title", "_p.name").alias("name"), first_of("city", "_p.city", "nationality").alias("place"), listed("exhibitions"), listed("articles")]
    if provenance:
        out.append(F.coalesce("_p.provenance", "_p.artist_payload_provenance", F.create_map().cast("map<string,string>")).alias("provenance"))
    return p.select(*out)


def write_feed(feed: DataFrame, path: str) -> None:
    """JSON lines without null fields, a folder for each type."""
    feed.write.mode("overwrite").option("ignoreNullFields", "true").partitionBy("record_type").json(path)


def write_csv(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("header", "true").csv(path)


def first_of(*columns: str) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def select_and_mark(records: DataFrame, delivered: DataFrame) -> DataFrame:
    """Approved rows; those whose id was delivered become exported."""
    done = delivered.select("id").distinct().withColumn("done", F.lit(True))
    return records.where("status = 'approved'").join(done, "id", "left").select("id", F.when(F.col("done"), "exported").otherwise("approved").alias("status"))


def events_csv(events: DataFrame, cap: int = 5000) -> DataFrame:
    """Newest rows as texts under a fixed header."""
    rows = events.orderBy(F.desc("ts"), F.desc("id")).limit(cap)
    return rows.select(F.col("id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("level").alias("event_type"), F.col("service").alias("user_id"), F.coalesce("context", F.lit("")).alias("metadata"))


def normalize_logs(events: DataFrame, service: str, arrived: Column, method: str = "info") -> DataFrame:
    """Event rows (batch or stream; payload: a JSON object) to log rows.

    The level is the event's, else the method's, unknown ones become info; a time that can't be read is the arrival; all
    keys without a column of their own are folded into the context as texts, null without any. A payload that is no object
    gives a row without message.
    """
    p = F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>"))
    at = lambda k: F.try_element_at("_p", F.lit(k))
    level = F.lower(F.coalesce(at("level"), F.lit(method)))
    rest = F.map_filter("_p", lambda k, v: ~k.isin("event", "level", "timestamp", "source_id"))
    return events.withColumn("_p", p).select(
        *[c for c in events.columns if c != "payload"], F.coalesce(F.try_to_timestamp(at("timestamp")), arrived).alias("timestamp"), F.when(level.isin(*LEVELS), level).otherwise("info").alias("level"), F.lit(service).alias("service"),
        at("source_id").alias("source_id"), F.coalesce(at("event"), F.lit("")).alias("message"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("context"),
    )


def _pages(s, d):
    return view(s, d, "pages").select(F.col("page_id").alias("id"), "url", "html")


def _images(s, d):
    return view(s, d, "pages_v").select((F.col("id") % 60).alias("record_id"), F.col("id").alias("image_id"), F.col("url").alias("image_url"), (F.col("id") % 3 != 0).alias("is_valid"))


def _loaded(s, d):
    out = None
    for name, schema in SCHEMAS.items():
        one = load_table(s, f"{d}/{name}.parquet", schema).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(schema.split()[0]).alias("keys"))
        out = one if out is None else out.union(one)
    return out


def raw_events(e: DataFrame) -> DataFrame:
    """Events as JSON: a level for two of three, every fifth time unreadable, user and k beyond the known keys."""
    when = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    fields = F.struct(F.concat("event_type", F.lit(" seen")).alias("event"), F.when(F.col("event_id") % 3 > 0, F.upper("event_type")).alias("level"), when.alias("timestamp"), F.col("user_id").alias("user"), F.get_json_object("props", "$.k").alias("k"))
    return e.select("event_id", F.to_json(fields).alias("payload"))


QUERIES = {
    "load_table": _loaded,
    "ingest_pages": lambda s, d: ingest_pages(_pages(s, d)).select("id", "host", "content_hash", "title", "chars"),
    "export_feed": lambda s, d: export_feed(view(s, d, "records_v"), _images(s, d)).select("id", "record_type", "title", "city", F.to_json("images").alias("images"), "primary_image", "confidence.score", "confidence.band"),
    "export_artists": lambda s, d: export_artists(view(s, d, "records_v").where("status = 'approved'")).select("id", "name", "place", F.array_join("exhibitions", "; ").alias("exhibitions"), F.array_join("articles", "; ").alias("articles")),
    "export_exhibitions": lambda s, d: view(s, d, "records_v").where("record_type = 'exhibition'").select("id", "title", F.array_join(F.from_json(F.concat(F.lit('["'), "nationality", F.lit('","'), "source_id", F.lit('"]')), "array<string>"), "; ").alias("artists")),
    "export_select_and_mark": lambda s, d: select_and_mark(view(s, d, "records_v"), view(s, d, "records_v").where("id % 3 = 0")),
    "export_history": lambda s, d: view(s, d, "records_v").where("status = 'approved'").select("id", "source_id", "updated_at").orderBy(F.desc("updated_at"), "id").offset(5).limit(100),
    "export_events_csv": lambda s, d: events_csv(view(s, d, "log_v").where("level <> 'debug'"), 2000),
}

ORACLE = {k: with_views(v) for k, v in {
    "load_table": "select 'region' as name, count(*) as n, count(distinct r_regionkey) as keys from region union all select 'nation' as name, count(*) as n, count(distinct n_nationkey) as keys from nation union all select 'customer' as name, count(*) as n, count(distinct c_custkey) as keys from customer union all select 'supplier' as name, count(*) as n, count(distinct s_suppkey) as keys from supplier union all select 'part' as name, count(*) as n, count(distinct p_partkey) as keys from part union all select 'orders' as name, count(*) as n, count(distinct o_orderkey) as keys from orders union all select 'lineitem' as name, count(*) as n, count(distinct l_orderkey) as keys from lineitem union all select 'events' as name, count(*) as n, count(distinct event_id) as keys from events union all select 'documents' as name, count(*) as n, count(distinct doc_id) as keys from documents union all select 'embeddings' as name, count(*) as n, count(distinct vec_id) as keys from embeddings union all select 'pages' as name, count(*) as n, count(distinct page_id) as keys from pages union all select 'benchmark' as name, count(*) as n, count(distinct item_id) as keys from benchmark union all select 'labels' as name, count(*) as n, count(distinct doc_id) as keys from labels union all select 'conversations' as name, count(*) as n, count(distinct conv_id) as keys from conversations",
    "ingest_pages": f"with p as (select page_id as id, url, substr(replace(html, chr(0), ''), 1, {HTML_CHARS}) as h from pages) select id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) as host, sha256(h) as content_hash, trim(regexp_extract(h, '<title>([^<]*)</title>', 1)) as title, cast(length(h) as int) as chars from p",
    "export_feed": """with i as (select id % 60 as record_id, '[' || string_agg('{"image_id":' || id || ',"image_url":"' || url || '"}', ',' order by id) || ']' as images, min_by(url, id) as primary_image from pages_v where id % 3 <> 0 group by 1) select id, record_type, nullif(trim(title), '') as title, nullif(trim(city), '') as city, images, primary_image, confidence_score as score, confidence_band as band from records_v left join i on id = record_id""",
    "export_artists": "select id, nullif(trim(title), '') as name, coalesce(nullif(trim(city), ''), nullif(trim(nationality), '')) as place, case id % 5 when 1 then 'a' when 2 then 'a; b; c' else '' end as exhibitions, case when id % 3 = 0 then 'x' else '' end as articles from records_v where record_type = 'artist' and status = 'approved'",
    "export_exhibitions": "select id, title, nationality || '; ' || source_id as artists from records_v where record_type = 'exhibition'",
    "export_select_and_mark": "select id, case when id % 3 = 0 then 'exported' else 'approved' end as status from records_v where status = 'approved'",
    "export_history": "select id, source_id, updated_at from records_v where status = 'approved' order by updated_at desc, id limit 100 offset 5",
    "export_events_csv": "select id::varchar as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, level as event_type, service as user_id, coalesce(context, '') as metadata from log_v where level <> 'debug' order by ts desc, log_v.id desc limit 2000",
}.items()}
