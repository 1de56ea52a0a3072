"""Adapter views: the driver's tables seen as records, pages, frontiers, jobs, logs, edges.

Each view is one statement that Spark and DuckDB both run, so queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "records_v": """
        select d.doc_id as id, d.source as source_id,
               case d.doc_id % 6 when 0 then 'artist' when 1 then 'artwork' when 2 then 'exhibition' when 3 then 'event' when 4 then 'venue' else 'organization' end as record_type,
               substr(split_part(d.text, '.', 1), 1, 160) as title, d.text as description, d.lang as nationality,
               case when l.quality = 1 then 'approved' when l.quality = 0 then 'rejected' else 'pending' end as status,
               cast(d.doc_id % 101 as int) as confidence_score,
               case when d.doc_id % 101 >= 70 then 'HIGH' when d.doc_id % 101 >= 40 then 'MEDIUM' else 'LOW' end as confidence_band,
               coalesce(l.toxic = 1, false) as has_conflicts, cast((d.doc_id * 7) % 101 as int) as completeness_score,
               case when d.doc_id % 3 = 0 then '' when d.doc_id % 3 = 1 then d.source end as city,
               case when d.doc_id % 4 = 0 then null else concat('https://', d.source, '.example.com/p/', cast(d.doc_id as varchar(20))) end as url,
               timestamp '2024-01-01 00:00:00' + d.doc_id * interval '1' minute as updated_at, d.n_chars,
               concat('{"id": ', cast(d.doc_id as varchar(20)), case d.doc_id % 5 when 0 then ', "exhibitions": []' when 1 then ', "exhibitions": ["a"]' when 2 then ', "exhibitions": ["a", "b", "c"]' else '' end,
                      case when d.doc_id % 3 = 0 then ', "articles": ["x"]' else '' end, '}') as raw_data
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "pages_v": """
        select page_id as id, url, html, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as source_id,
               regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path,
               case page_id % 4 when 0 then 'fetched' when 1 then 'extracted' when 2 then 'error' else 'pending' end as status,
               timestamp '2024-01-01 00:00:00' + page_id * interval '1' minute as fetched_at
        from pages""",
    "frontier_v": """
        select id, source_id, url, cast(id % 4 as int) as depth, cast(case id % 3 when 0 then 80 when 1 then 50 else 5 end as int) as priority,
               case id % 5 when 0 then 'queued' when 1 then 'failed_retryable' when 2 then 'fetched' when 3 then 'discovered' else 'skipped' end as status,
               case when id % 2 = 0 then fetched_at end as next_retry_at, case when id % 3 = 0 then fetched_at + interval '7' day end as next_eligible_at,
               fetched_at as created_at, case id % 7 when 0 then 'selector_miss' when 1 then 'robots' end as skip_reason,
               case id % 4 when 0 then 'changed' when 1 then 'unchanged' end as last_refresh_outcome, path as family_key
        from pages_v""",
    "sources_v": """
        select s.s_suppkey as id, s.s_name as name, r.r_name as tenant, s.s_acctbal > 0 as enabled, concat('https://s', cast(s.s_suppkey as varchar(20)), '.example.com') as url,
               case s.s_suppkey % 4 when 0 then 'crawling' when 1 then 'mapping' when 2 then 'done' else 'pending' end as status
        from supplier s join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey""",
    "jobs_v": """
        select o_orderkey as id, o_custkey as source_id, case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'pending' end as status,
               lower(split_part(o_orderpriority, '-', 2)) as job_type, o_orderdate as created_at, cast(o_orderkey % 4 as int) as attempts,
               cast(floor(o_totalprice) as bigint) as items, o_orderdate + (o_orderkey % 90) * interval '1' minute as heartbeat_at
        from orders""",
    "log_v": """
        select event_id as id, ts, case event_type when 'error' then 'error' when 'click' then 'info' when 'view' then 'debug' else event_type end as level,
               concat('u', cast(user_id as varchar(20))) as service, concat(event_type, ' by ', cast(user_id as varchar(20))) as message, props as context, user_id as source_id, value
        from events""",
    "edges_v": """
        select l_partkey as from_id, l_suppkey as to_id, l_returnflag as edge_type, 1 - l_discount as confidence, l_orderkey as record_id, l_linenumber as line from lineitem""",
    "mapping_rows_v": """
        select l_orderkey as preset_id, l_linenumber * 1000000000000 + l_partkey * 1000 + l_suppkey % 1000 as sort_order,
               case l_partkey % 8 when 0 then 'artist_detail' when 1 then 'event_detail' when 2 then 'listing' when 3 then 'root_page' when 4 then 'Venue Page' when 5 then 'artwork_detail' when 6 then 'exhibition' end as page_type_key,
               case l_partkey % 3 when 0 then concat('Type ', cast(l_linenumber as varchar(20))) when 1 then '' end as page_type_label,
               case l_suppkey % 6 when 0 then 'h1.title' when 1 then 'a[HREF]' when 2 then 'img.hero' when 4 then 'a.next' when 5 then '.body p' end as selector,
               case l_partkey % 11 when 0 then 'title' when 1 then 'source_url' when 2 then 'hero_image' when 4 then 'next_page' when 5 then 'bio' when 6 then 'avatar' when 7 then 'document' when 8 then 'thumbnail' when 9 then 'ticket_link' when 10 then '' end as destination_field,
               case when l_suppkey % 5 = 1 then 'HREF' end as attribute_name, case when l_suppkey % 7 = 2 then 'image' else 'text' end as extraction_mode,
               case when l_linenumber = 5 then 'Pagination' end as category_target,
               case l_partkey % 4 when 0 then 'artist' when 1 then 'event' when 3 then 'artwork' end as destination_entity,
               l_linenumber % 3 = 0 as is_required, l_suppkey % 9 <> 0 as is_enabled, case l_returnflag when 'A' then 'approved' when 'R' then 'rejected' else 'draft' end as status
        from lineitem""",
    "templates_v": """
        select o_orderkey as id,
               case o_orderkey % 11
                   when 0 then concat('{"crawl_plan": {"phases": [{"phase_name": "root"}]}, "extraction_rules": {"artist": {"css_selectors": {"title": "h1", "n": "p"}, "identifiers": ["/artists/", "/x/', cast(o_orderkey as varchar(20)), '"]}}}')
                   when 1 then concat('{"crawl_plan": ', cast(o_orderkey as varchar(20)), ', "extraction_rules": ')
                   when 2 then concat('[', cast(o_orderkey as varchar(20)), ']')
                   when 3 then concat('{"mining_map": {"k": ', cast(o_orderkey as varchar(20)), '}}')
                   when 4 then '{"crawl_plan": {"phases": []}, "page_type_rules": {"a": {}}, "extraction_rules": {}}'
                   when 5 then '{"crawl_plan": {"phases": [1]}, "extraction_rules": []}'
                   when 6 then '{"crawl_plan": [], "extraction_rules": {"b": "x", "a": {"css_selectors": ["h1"], "identifiers": ["/"]}}}'
                   when 7 then '{"crawl_plan": {"phases": {"a": 1}}, "extraction_rules": {"z": {"css_selectors": {"t": " ", "b": 7, "c": null, "d": "DIV"}, "identifiers": ["ab", "/abc"]}}}'
                   when 8 then '{"crawl_plan": {}, "extraction_rules": {"z": {"css_selectors": null, "identifiers": []}, "y": {}}}'
                   when 9 then concat('{"extraction_rules": {"e', cast(o_orderkey as varchar(20)), '": {"css_selectors": {"t": "h1"}, "identifiers": "/events/"}}, "crawl_plan": null}')
               end as template
        from orders""",
    "links_v": """
        select l_partkey as entity_id, l_orderkey * 10 + l_linenumber as record_id, l_suppkey as source_id, l_quantity / 50 as confidence from lineitem""",
    "entities_v": """
        select p_partkey as id, p_type as entity_type, p_name as name, p_brand as city, p_size as year, p_retailprice as confidence from part""",
    "vectors_v": "select vec_id as id, embedding, label from embeddings",
    "signals_v": """
        select event_id as id, user_id as source_id, event_type as signal_type, ts as detected_at,
               case when value >= 60 then 'high' when value >= 20 then 'medium' else 'low' end as severity, case event_id % 3 when 0 then 'open' when 1 then 'acknowledged' else 'resolved' end as status,
               concat('f', cast(event_id % 9 as varchar(20))) as field, value from events""",
    "reviews_v": """
        select l_orderkey * 10 + l_linenumber as id, l_orderkey as left_id, l_orderkey + 32 as right_id, cast(l_quantity as int) as score, case l_linestatus when 'O' then 'pending' else 'decided' end as status from lineitem""",
}


def _names(sql: str) -> list[str]:
    return [x for x in (*VIEWS, *TABLES) if re.search(rf"\b{x}\b", sql)]


def with_views(sql: str) -> str:
    """A DuckDB statement with the views it names in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in _names(text):
            if name in VIEWS and name not in need:
                add(VIEWS[name])
                need.append(name)

    add(sql)
    if not need:
        return sql
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in need)
    body = sql.strip()
    return f"with {head}, {body[5:]}" if body[:5].lower() == "with " else f"with {head} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or an adapter view over the Parquet files of a folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("varchar(20)", "string").replace("{", "{{").replace("}", "}}")
    parts = [x for x in _names(sql) if x != name]
    for x in sorted(parts, key=len, reverse=True):
        sql = re.sub(rf"(\b(?:from|join)\s+){x}\b", rf"\1{{{x}}}", sql)
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in parts if "{" + x + "}" in sql})
