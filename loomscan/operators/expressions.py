"""Queries of the scalar expressions: each runs its expression over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.functions import urls as U
from loomscan.sources.views import view, with_views

#: Rules beside the fixed ones, for the URLs of the test pages.
PAGE_RULES = (*U.PAGE_TYPES, ("/[a-z]{2}/[0-9]+$", "detail"), (r"\.html$", "document"), ("/$", "listing"), (r"\?", "filtered"))
RESERVED = ("en", "login")


def _on(table, *columns):
    return lambda spark, sf_dir: view(spark, sf_dir, table).select(*columns() if callable(columns[0]) else columns)


def _c(*names):
    return [F.col(n) for n in names]


def _pages(name, make):
    return lambda spark, sf_dir: view(spark, sf_dir, "pages").select("page_id", make().alias(name))


def _docs(name, make):
    return lambda spark, sf_dir: view(spark, sf_dir, "documents").select("doc_id", make().alias(name))


def _records(*make):
    return lambda spark, sf_dir: view(spark, sf_dir, "records_v").select("id", *[m for f in make for m in f()])


_url, _text = lambda: F.col("url"), lambda: F.col("text")


def _completeness():
    score, missing, critical = S.typed_completeness(F.col("record_type"), _have())
    return [score.alias("score"), missing.alias("missing"), critical.alias("critical")]


def _have():
    return {"title": F.col("title"), "bio": F.col("description"), "description": F.col("description"), "nationality": F.col("nationality"), "city": F.col("city"), "source_url": F.col("url"), "website_url": F.col("url"), "venue_name": F.col("city"), "country": F.col("source_id")}


def _artist_completeness():
    ok = lambda c: F.coalesce(S.present(F.col(c)), F.lit(False))
    score, missing = S.artist_completeness(ok("title"), F.length("description") >= 200, ok("url"), F.col("n_chars") % 2 == 0, F.col("id") % 3 == 0, ok("city") | ok("nationality"), ok("source_id"))
    return [score.alias("score"), missing.alias("missing")]


def _confidence():
    ok = lambda c: F.coalesce(S.present(F.col(c)), F.lit(False))
    score, band, reasons = S.confidence_score(F.col("record_type"), ok("title"), ok("description"), F.col("description").rlike("[0-9]{4}"), ok("city"), F.col("id") % 3 == 0, ok("url"), F.col("n_chars") % 5 == 0, F.col("confidence_score"))
    return [score.alias("score"), band.alias("band"), reasons.alias("reasons")]


def _years():
    a, b = S.year_range(F.col("text"))
    return a, b


QUERIES = {
    "normalize_url": _pages("normalized", lambda: U.normalize_url(_url())),
    "path_pattern": _pages("pattern", lambda: U.path_pattern(_url())),
    "page_type_candidate": _pages("candidate", lambda: U.page_type_candidate(U.path_pattern(_url()))),
    "score_url": _pages("priority", lambda: U.score_url(_url())),
    "url_page_type": _pages("page_type", lambda: U.url_page_type(_url(), PAGE_RULES)),
    "profile_candidate": _pages("is_profile", lambda: U.profile_candidate(_url(), RESERVED)),
    "family_key": _pages("family", lambda: U.family_key(_url())),
    "captcha_flag": _pages("captcha", lambda: U.captcha_flag(F.col("html"))),
    "pagination_mode": lambda s, d: view(s, d, "pages_v").groupBy("source_id").agg(U.pagination_of(F.col("url")).alias("mode")),
    "include_rule": lambda s, d: view(s, d, "pages").select("page_id", U.include_rule(U.path_pattern(_url()), (F.col("page_id") % 100) / 100, F.col("page_id") % 5, F.when(F.col("page_id") % 3 == 0, "unknown").otherwise("detail")).alias("included")),
    "resolve_page_type": lambda s, d: view(s, d, "pages").select("page_id", *[c.alias(n) for n, c in zip(("page_type", "conflict"), U.resolve_page_type(U.page_type_candidate(U.path_pattern(_url())), (F.col("page_id") % 100) / 100, U.path_pattern(_url()), F.regexp_extract("html", "<title>([^<]*)</title>", 1)), strict=True)]),
    "section_type": lambda s, d: view(s, d, "documents").select("doc_id", U.section_type(F.col("text"), F.concat(F.lit("/"), "source")).alias("section"), U.section_pagination(F.col("text")).alias("pagination")),
    "normalize_email": _docs("email", lambda: U.normalize_email(_text())),
    "url_expand": lambda s, d: view(s, d, "sources_v").select("id", F.explode(U.expand_urls(F.concat("url", F.lit("/list/{letter}")), F.array(*map(F.lit, "abc")))).alias("target")),
    "normalize_name": _docs("name", lambda: S.normalize_name(F.col("text"))),
    "normalize_record_type": lambda s, d: view(s, d, "events").select("event_id", S.normalize_record_type(F.when(F.col("event_id") % 3 == 0, "Artist_Article ").when(F.col("event_id") % 3 == 1, "VENUE").otherwise(F.col("event_type"))).alias("record_type")),
    "record_fingerprint": lambda s, d: view(s, d, "records_v").select("id", S.record_fingerprint(F.col("record_type"), ("name", F.col("title")), ("city", F.col("city"))).alias("fingerprint")),
    "item_fingerprint": lambda s, d: view(s, d, "pages").select("page_id", S.item_fingerprint(F.col("url"), F.col("html")).alias("fingerprint")),
    "hash_embedding": lambda s, d: view(s, d, "entities_v").select("id", F.posexplode(S.hash_embedding(F.concat_ws(" ", "name", "entity_type"))).alias("bucket", "weight")).where("weight <> 0"),
    "cosine_similarity": lambda s, d: view(s, d, "vectors_v").alias("a").join(view(s, d, "vectors_v").alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), F.round(S.cosine_similarity(F.col("a.embedding"), F.col("b.embedding")), 5).alias("cosine")),
    "parse_embedding": lambda s, d: view(s, d, "vectors_v").select("id", F.size(S.parse_embedding(F.when(F.col("id") % 3 == 0, "bad").otherwise(F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))))).alias("dims")),
    "record_text": lambda s, d: view(s, d, "records_v").select("id", S.record_text(F.col("record_type"), F.col("title"), F.col("description"), F.col("nationality")).alias("body")),
    "completeness": _records(_completeness),
    "artist_completeness": _records(_artist_completeness),
    "confidence_score": _records(_confidence),
    "field_confidence": _records(lambda: [S.field_confidence(F.col("city"), F.when(F.col("id") % 2 == 0, F.col("completeness_score")), F.col("confidence_score")).alias("city_confidence"), S.field_confidence(F.col("url"), F.lit(None).cast("int"), F.col("confidence_score")).alias("url_confidence")]),
    "prepare_record": _records(lambda: [S.normalize_record_type(F.col("record_type")).alias("record_type"), S.normalize_name(F.col("title")).alias("normalized_name"), S.record_fingerprint(F.col("record_type"), ("name", S.normalize_name(F.col("title")))).alias("fingerprint")]),
    "year_range": lambda s, d: view(s, d, "documents").select("doc_id", _years()[0].alias("first_year"), _years()[1].alias("last_year")),
    "date_text": _docs("dates", lambda: S.date_text(_text())),
    "next_eligible": lambda s, d: view(s, d, "jobs_v").select("id", S.next_eligible(F.when(F.col("id") % 4 == 0, "realtime").when(F.col("id") % 4 == 1, "weekly").when(F.col("id") % 4 == 2, "manual").otherwise("other"), F.col("created_at")).alias("due")),
    "content_change": lambda s, d: view(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.content_change(F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")), F.col("l_linestatus"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_linestatus")).alias("change")),
    "retry_delay": lambda s, d: view(s, d, "events").select("event_id", S.retry_delay(F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")), (F.col("event_id") % 7).cast("int")).alias("delay")),
    "field_plausible": _records(lambda: [S.field_plausible(F.when(F.col("id") % 3 == 0, "website_url").when(F.col("id") % 3 == 1, "birth_year").otherwise("title"), F.coalesce("url", "title")).alias("plausible")]),
    "value_conflict": _records(lambda: [S.value_conflict(F.col("city"), F.col("source_id")).alias("city_conflict"), S.value_conflict(F.col("nationality"), F.substring("title", 1, 2)).alias("nationality_conflict")]),
    "image_role": lambda s, d: view(s, d, "pages").select("page_id", S.image_role(_url(), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("html"), F.regexp_extract("html", 'class="([^"]*)"', 1), F.col("page_id") % 3).alias("r")).select("page_id", "r.*"),
    "safe_numbers": lambda s, d: view(s, d, "events").select("event_id", S.safe_int(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "NaN").otherwise(F.col("value").cast("string")), -1).alias("n")),
    "jaccard": lambda s, d: view(s, d, "entities_v").alias("a").join(view(s, d, "entities_v").alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), F.round(S.jaccard(S.name_tokens(F.col("a.name")), S.name_tokens(F.col("b.name"))), 6).alias("overlap")),
    "shared_links": _records(lambda: [S.shared_links([F.col("url"), F.col("city")], [F.col("source_id"), F.col("nationality")]).alias("shared")]),
    "ordered_pair": lambda s, d: view(s, d, "edges_v").select("record_id", "line", F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high")),
}

_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_PATTERN = f"'/' || array_to_string(list_transform({_PARTS}, lambda x: case when regexp_matches(x, '^[0-9]+$') then '{{num}}' when regexp_matches(x, '^[0-9a-fA-F]{{8,}}$') then '{{hex}}' when regexp_matches(x, '[0-9]') then '{{slug}}' else lower(x) end), '/')"
_HINT = " ".join(f"when contains(lower({{p}}), '{h}') then '{k}'" for h, k in U.TYPE_HINTS)


def _any(text, words):
    return "(" + " or ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _when(text, rules):
    return " ".join(f"when {_any(text, w if isinstance(w, tuple) else (w,))} then '{k}'" for k, w in rules)


_PREDICTED = "case " + _when(f"lower({_PATH})", [(k, "/" + w) for w, k in U.DETAIL]) + f" when {_any(f'lower({_PATH})', ['/' + w for w in U.UTILITY])} then 'utility' else 'generic' end"
_PRIORITY = f"cast(case {_PREDICTED} when 'utility' then 5 when 'generic' then 30 else 80 end as int)"


def _candidate(p):
    return f"case {_HINT.format(p=p)} when len(list_filter(string_split({p}, '/'), lambda x: x <> '')) <= 1 then 'listing' else 'generic_detail' end"


_TYPE = "case " + " ".join(f"when regexp_matches(url, '(?i){p}') then '{k}'" for p, k in PAGE_RULES) + " end"
_PRESENT = "({0} is not null and trim({0}) not in ('', '[]', '{{}}'))"
_OK = lambda c: _PRESENT.format(c)
_NAME = "regexp_replace(regexp_replace(trim(lower({0})), '[ \\t\\r\\n]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


def _checks(checks):
    total = "least(100, " + " + ".join(f"case when {c} then {w} else 0 end" for _, c, w in checks) + ")"
    missing = "array_to_string(list_filter([" + ", ".join(f"case when not coalesce({c}, false) then '{n}' end" for n, c, _ in checks) + "], lambda x: x is not null), ',')"
    return total, missing


_T = lambda c: f"coalesce({_OK(c)}, false)"
_A = _checks([("artist_name", _T("title"), 20), ("bio", "length(description) >= 200", 20), ("website_or_email", _T("url"), 15), ("images", "n_chars % 2 = 0", 10), ("exhibitions_articles_press", "id % 3 = 0", 20), ("location_or_nationality", f"({_T('city')} or {_T('nationality')})", 5), ("source_pages", _T("source_id"), 10)])
_B = [(_T("title"), 20, "'title present'"), (_T("description"), 15, "'description present'"), ("(record_type in ('event', 'exhibition') and regexp_matches(description, '[0-9]{4}'))", 15, "'date present'"), (_T("city"), 10, "'venue present'"), ("id % 3 = 0", 10, "'artists linked'"), (_T("url"), 15, "case record_type when 'artist' then 'avatar image found' else 'image found' end"), ("n_chars % 5 = 0", 10, "'JSON-LD source'"), ("confidence_score >= 80", 5, "'high AI confidence'")]
_HAVE = {"title": "title", "bio": "description", "description": "description", "nationality": "nationality", "city": "city", "source_url": "url", "website_url": "url", "venue_name": "city", "country": "source_id"}
_FIELDS = "(values " + ", ".join(f"('{k}', '{f}', {str(f in first).lower()}, {n})" for k, (first, rest) in S.TYPE_FIELDS.items() for n, f in enumerate((*first, *rest))) + ") t(kind, field, critical, place)"
_VALUE = "case field " + " ".join(f"when '{f}' then {c}" for f, c in _HAVE.items()) + " end"
_FULL = "case when regexp_matches(url, '^[A-Za-z]+://') then url else 'https://' || url end"

#: The two tables of page types, spelled out once more for SQL over k (the candidate), b (pattern and signals) and l (the pattern), all lower-cased.
MAPPED = "case k when 'listing' then 'listing' when 'generic_detail' then 'detail' when 'artist' then 'artist' when 'artwork' then 'artwork' when 'exhibition' then 'exhibition' when 'event' then 'exhibition' when 'document' then 'document' else 'generic' end"
SPOKEN = "case when contains(b, 'artist') then 'artist' when contains(b, 'artwork') or contains(b, '/works/') then 'artwork' when contains(b, 'exhibition') or contains(b, 'event') or contains(b, 'show') then 'exhibition' when contains(b, '.pdf') or contains(b, 'document') or contains(b, 'catalog') then 'document' when contains(b, 'news') or contains(b, 'blog') or contains(b, 'index') or contains(b, 'archive') then 'listing' when len(list_filter(string_split(l, '/'), lambda x: x <> '')) >= 3 then 'detail' else 'generic' end"

ORACLE = {k: with_views(v) for k, v in {
    "normalize_url": f"""with f as (select page_id, {_FULL} as u from pages),
        g as (select page_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) as place, regexp_replace({_PATH.replace('url', 'u')}, '/+$', '') as p,
              array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') as q from f)
        select page_id, scheme || '://' || case scheme when 'http' then regexp_replace(place, ':80$', '') when 'https' then regexp_replace(place, ':443$', '') else place end || case when p = '' then '/' else p end || case when q = '' then '' else '?' || q end as normalized from g""",
    "path_pattern": f"select page_id, {_PATTERN} as pattern from pages",
    "page_type_candidate": f"with p as (select page_id, {_PATTERN} as pattern from pages) select page_id, {_candidate('pattern')} as candidate from p",
    "score_url": f"select page_id, {_PRIORITY} as priority from pages",
    "url_page_type": f"select page_id, {_TYPE} as page_type from pages",
    "profile_candidate": f"select page_id, len({_PARTS}) = 1 and not contains(lower({_PARTS}[1]), '.') and lower({_PARTS}[1]) not in {RESERVED} as is_profile from pages",
    "family_key": f"select page_id, case when {_PARTS}[1] is not null and not ends_with(lower({_PARTS}[1]), '.php') then lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) || '::' || lower({_PARTS}[1]) end as family from pages",
    "captcha_flag": "select page_id, regexp_matches(lower(html), 'captcha|cf-chl|cloudflare challenge|are you human') as captcha from pages",
    "pagination_mode": "select source_id, case when bool_or(regexp_matches(url, '[?&](page|p|offset|start)=')) then 'query_param' when bool_or(regexp_matches(url, '/page/[0-9]+')) then 'path_segment' else 'none' end as mode from pages_v group by 1",
    "include_rule": f"with p as (select page_id, {_PATTERN} as pattern, (page_id % 100) / 100 as c, page_id % 5 as n, case when page_id % 3 = 0 then 'unknown' else 'detail' end as t from pages) select page_id, case when {_any('lower(pattern)', (*U.EXCLUDED, *U.UTILITY_FAMILY))} or (c < 0.35 and n <= 1) then false when n >= 3 or c >= 0.7 then true else t <> 'unknown' and c >= 0.45 end as included from p",
    "resolve_page_type": f"with p as (select page_id, (page_id % 100) / 100 as c, {_PATTERN} as pattern, regexp_extract(html, '<title>([^<]*)</title>', 1) as dom from pages), q as (select *, {_candidate('pattern')} as k, lower(pattern || ' ' || dom) as b, lower(pattern) as l from p), r as (select *, {MAPPED} as m, {SPOKEN} as o from q) select page_id, case when c >= 0.72 then m else o end as page_type, c < 0.72 and m <> o as conflict from r",
    "section_type": "with d as (select doc_id, lower(text) as n, '/' || source as u from documents) select doc_id, case " + " ".join(f"when {_any('u', w)} or {_any('n', [x.strip('/') for x in w])} then '{k}'" for k, w in U.SECTIONS) + " else 'unknown' end as section, case " + _when("n", U.PAGINATION) + " else 'none' end as pagination from d",
    "normalize_email": "select doc_id, nullif(regexp_extract(regexp_replace(lower(trim(text)), '^mailto:|\\?.*$', '', 'g'), '([a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]+)', 1), '') as email from documents",
    "url_expand": "select id, url || '/list/' || unnest(['a', 'b', 'c']) as target from sources_v",
    "normalize_name": f"select doc_id, {_NAME.format('text')} as name from documents",
    "normalize_record_type": "select event_id, case when event_id % 3 = 0 then 'artwork' when event_id % 3 = 1 then 'venue' when event_type in ('artist', 'artwork', 'exhibition', 'event', 'venue', 'organization') then event_type end as record_type from events",
    "record_fingerprint": "select id, sha256('v1|' || record_type || '|city=' || coalesce(trim(lower(city)), '') || '|name=' || coalesce(trim(lower(title)), '')) as fingerprint from records_v",
    "item_fingerprint": "select page_id, sha1(url || '|' || html) as fingerprint from pages",
    "hash_embedding": f"with t as (select id, unnest({_WORDS.format('concat_ws(chr(32), name, entity_type)')}) as w from entities_v), b as (select id, cast(('0x' || substr(sha256(w), 1, 8))::ubigint % 96 as int) as bucket, count(*) as n from t group by 1, 2) select id, bucket, round(n / sqrt(sum(n * n) over (partition by id)), 6) as weight from b",
    "cosine_similarity": "select a.id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine from vectors_v a join vectors_v b on b.id = a.id + 1",
    "parse_embedding": "select id, cast(case when id % 3 = 0 then 0 else len(embedding) end as int) as dims from vectors_v",
    "record_text": "select id, case record_type when 'artist' then concat_ws(' ', title, nationality, description) when 'exhibition' then concat_ws(' ', title, description) end as body from records_v",
    "completeness": f"with c as (select id, field, critical, coalesce(trim({_VALUE}) not in ('', '[]', '{{}}'), false) as ok, place from records_v join {_FIELDS} on kind = record_type), g as (select id, cast(floor(count_if(ok) * 100 / count(*)) as int) as score, list(field order by place) filter (not ok) as missing, list(field order by place) filter (not ok and critical) as critical from c group by 1) select r.id, coalesce(score, 0) as score, coalesce(array_to_string(missing, ','), '') as missing, coalesce(array_to_string(critical, ','), '') as critical from records_v r left join g on g.id = r.id",
    "artist_completeness": f"select id, {_A[0]} as score, {_A[1]} as missing from records_v",
    "confidence_score": "with r as (select id, least(100, " + " + ".join(f"case when {c} then {w} else 0 end" for c, w, _ in _B) + ") as score, array_to_string(list_filter([" + ", ".join(f"case when {c} then {y} end" for c, _, y in _B) + "], lambda x: x is not null), ',') as reasons from records_v) select id, score, case when score >= 70 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end as band, reasons from r",
    "field_confidence": f"select id, case when {_OK('city')} then coalesce(case when id % 2 = 0 then completeness_score end, confidence_score) end as city_confidence, case when {_OK('url')} then confidence_score end as url_confidence from records_v",
    "prepare_record": f"select id, record_type, {_NAME.format('title')} as normalized_name, sha256('v1|' || record_type || '|name=' || trim(lower({_NAME.format('title')}))) as fingerprint from records_v",
    "year_range": "with d as (select doc_id, list_transform(regexp_extract_all(text, '\\b((?:19|20)[0-9][0-9])\\b', 1), lambda x: x::int) as y from documents) select doc_id, list_min(y) as first_year, list_max(y) as last_year from d",
    "date_text": "with d as (select doc_id, regexp_extract_all(text, '([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})', 1) as y from documents) select doc_id, nullif(array_to_string(y[1:2], ' - '), '') as dates from d",
    "next_eligible": "select id, case id % 4 when 0 then created_at + interval '5' minute when 1 then created_at + interval '7' day when 2 then null else created_at + interval '1' day end as due from jobs_v",
    "content_change": "with x as (select l_orderkey, l_linenumber, case when l_partkey % 2 = 0 then l_returnflag end as a, l_linestatus as b, l_suppkey::varchar as e, l_linenumber::varchar as f, l_returnflag as m, l_linestatus as n from lineitem) select l_orderkey, l_linenumber, case when a is not null and b is not null then case when a <> b then 'hash' else 'unchanged' end when e <> f then 'etag' when m <> n then 'last_modified' else 'unchanged' end as change from x",
    "retry_delay": "select event_id, cast(case when event_id % 2 = 0 then user_id else least(300, 10 * pow(2, event_id % 7)) end as int) as delay from events",
    "field_plausible": "with r as (select id, trim(coalesce(url, title)) as v from records_v) select id, case when v = '' then false when id % 3 = 0 then regexp_matches(v, '^(https?://|/)') when id % 3 = 1 then regexp_matches(v, '^[0-9]+$') and coalesce(try_cast(v as int) between 1000 and 2100, false) else lower(v) not in ('n/a', 'unknown', 'none', 'click here', 'read more') and length(v) >= 2 end as plausible from r",
    "value_conflict": f"select id, coalesce({_OK('city')} and {_OK('source_id')} and trim(city) <> trim(source_id), false) as city_conflict, coalesce({_OK('nationality')} and {_OK('substr(title, 1, 2)')} and trim(nationality) <> trim(substr(title, 1, 2)), false) as nationality_conflict from records_v",
    "image_role": f"with p as (select page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) || ' ' || lower(regexp_extract(html, 'class=\"([^\"]*)\"', 1)) || ' ' || lower(url) as o, lower(html) as h, lower(regexp_extract(html, 'class=\"([^\"]*)\"', 1)) as c, page_id % 3 as n from pages), q as (select page_id, case when {_any('o', S.PROFILE_IMAGE)} then 1 when {_any('o', S.ARTWORK_IMAGE)} then 2 when contains(h, 'artist') and contains(h, 'photo') then 3 when {_any('c', S.TEMPLATE_ZONE)} then 4 when {_any('o', S.TEMPLATE_IMAGE)} then 5 when {_any('o', S.DECORATIVE_IMAGE)} or {_any('h', S.DECORATIVE_IMAGE)} then 6 when n > 1 then 7 else 8 end as k from p) select page_id, ['profile', 'artwork', 'artist_photo', 'template_shared', 'template_shared', 'decorative', 'template_shared', 'unknown'][k] as role, [88, 82, 78, 74, 72, 70, 68, 50][k] as confidence, ['keyword_profile', 'keyword_artwork', 'context_artist_photo', 'dom_zone_template', 'keyword_template', 'decorative_context', 'repeated_across_page', 'fallback_unknown'][k] as reason from q",
    "safe_numbers": "select event_id, cast(case when event_id % 3 in (0, 1) then -1 else floor(value) end as bigint) as n from events",
    "jaccard": f"with t as (select id, list_distinct(list_filter(regexp_split_to_array(lower(name), '[ \\t\\r\\n-]+'), lambda x: x <> '')) as w from entities_v) select a.id, round(case when len(list_distinct(list_concat(a.w, b.w))) > 0 then len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) else 0 end, 6) as overlap from t a join t b on b.id = a.id + 1",
    "shared_links": "select id, case when coalesce(nullif(url, '') in (source_id, nationality), false) or coalesce(nullif(city, '') in (source_id, nationality), false) then 1 else 0 end as shared from records_v",
    "ordered_pair": "select record_id, line, least(from_id, to_id) as low, greatest(from_id, to_id) as high from edges_v",
}.items()}
