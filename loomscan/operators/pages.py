"""Web-page jobs: links, classification, cleaning, items. Nodes and selectors are in `selectors`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.functions import urls as U
from loomscan.operators.expressions import _any, _when
from loomscan.sources.views import view, with_views

def extract_links(pages: DataFrame) -> DataFrame:
    """A row per link in order: absolute and without fragment, on the page's own host; comments and scripts hold no links."""
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", " ")
    found = pages.select("id", "url", "source_id", F.posexplode(F.regexp_extract_all(bare, F.lit(U.LINK), F.lit(1))).alias("pos", "raw"))
    href = F.replace(F.regexp_replace("raw", "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))
    return found.withColumn("target", U.resolve(F.col("url"), href)).where(F.col("target").isNotNull() & (U.host(F.col("target")) == F.col("source_id"))).select("id", "source_id", "pos", "target")


def discover_frontier(links: DataFrame, known: DataFrame, max_depth: int = 3) -> DataFrame:
    """Links (with the depth of their page) that are not known yet, once each: the first page that found them, its depth plus one up to a bound, type and priority."""
    new = links.where(F.col("depth") < max_depth).groupBy("source_id", "target").agg(F.min(F.struct("id", "depth")).alias("first")).select("source_id", "target", F.col("first.id").alias("found_on"), (F.col("first.depth") + 1).alias("depth"))
    fresh = new.join(known.select("source_id", F.col("url").alias("target")), ["source_id", "target"], "left_anti").withColumn("page_type", U.predicted_type(F.col("target")))
    return fresh.withColumn("priority", U.priority_of(F.col("page_type")))


def clean_html(html: Column) -> Column:
    """Without scripts, styles, navigation, footers, comments and tags; blanks collapsed."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "noscript", "iframe"):
        bare = F.regexp_replace(bare, rf"(?s)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"[ \t\r\n]+", " "))


#: What links of a hub page say, and what a directory page says.
HUB_LABELS = ("biography", "exhibitions", "articles", "press reviews", "memories")
DIRECTORY_TEXT = "artist names starting with"


def classify(pages: DataFrame) -> DataFrame:
    """JSON-LD type (95), URL rule (75), content label (80), else unknown (0), in that order."""
    ld = F.regexp_extract("html", r'"@type"\s*:\s*"([A-Za-z]+)"', 1)
    by_ld = F.when(F.lit(False), "")
    for name, kind in U.LD_TYPES.items():
        by_ld = by_ld.when(ld == name, kind)
    by_url = U.url_page_type(F.col("url"))
    low = F.lower("html")
    hub = F.lit(True)
    for label in HUB_LABELS:
        hub = hub & low.rlike(rf">\s*{label}\s*</a>")
    by_text = F.when(F.contains(low, F.lit(DIRECTORY_TEXT)), "artist_directory_letter").when(hub, "artist_profile_hub")
    found = pages.select("id", by_ld.alias("a"), by_url.alias("b"), by_text.alias("c"))
    return found.select("id", F.coalesce("a", "b", "c", F.lit("unknown")).alias("page_type"), F.when(F.col("a").isNotNull(), 95).when(F.col("b").isNotNull(), 75).when(F.col("c").isNotNull(), 80).otherwise(0).alias("confidence"))


def extraction_gate(pages: DataFrame, stored: DataFrame, gate: int = 80) -> DataFrame:
    """Where each page (id, content_hash, status, confidence) goes against what is stored (id, content_hash): unchanged, review with its reason, or persist."""
    before = stored.select("id", F.col("content_hash").alias("before"))
    route = F.when(F.col("content_hash") == F.col("before"), "unchanged").when((F.col("status") == "error") | (F.col("confidence") < gate), "review").otherwise("persist")
    reason = F.when(F.col("content_hash") == F.col("before"), None).when(F.col("status") == "error", "fetch_error").when(F.col("confidence") < gate, "low_confidence")
    return pages.join(before, "id", "left").select("id", route.alias("route"), reason.alias("reason"))


def child_records(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items (id, source_id, item) to one child record a fingerprint, with its first parent; fingerprints that are stored are left out."""
    named = items.select("id", "source_id", "item", S.item_fingerprint(F.col("source_id"), F.col("item")).alias("fingerprint"))
    return named.groupBy("fingerprint").agg(F.min_by("item", "id").alias("title"), F.min("id").alias("parent_id")).join(stored.select("fingerprint"), "fingerprint", "left_anti")


QUERIES = {
    "extract_links": lambda s, d: extract_links(view(s, d, "pages_v")),
    "discover_frontier": lambda s, d: discover_frontier(extract_links(view(s, d, "pages_v")).withColumn("depth", (F.col("id") % 4).cast("int")), view(s, d, "pages_v")),
    "directory_expand": lambda s, d: extract_links(view(s, d, "pages_v")).where(U.profile_candidate(F.col("target"), ("en", "is", "the"))).select("source_id", "target").distinct(),
    "regex_extract": lambda s, d: view(s, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<h1[^>]*>([^<]+)</h1>", 1), F.lit("")).alias("heading"), F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("")).alias("lang")),
    "classify_pages": lambda s, d: classify(view(s, d, "pages_v")),
    "date_signal": lambda s, d: view(s, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"), F.lit(1))).alias("dates")),
    "clean_html": lambda s, d: view(s, d, "pages").select("page_id", clean_html(F.col("html")).alias("body")),
    "child_records": lambda s, d: child_records(view(s, d, "records_v").select("id", "source_id", F.explode(F.array("title", "nationality")).alias("item")), view(s, d, "records_v").where("status = 'approved'").select(S.item_fingerprint(F.col("source_id"), F.col("title")).alias("fingerprint"))),
    "backfill_merge": lambda s, d: view(s, d, "records_v").select("id", F.coalesce(F.when(S.present(F.col("city")), F.col("city")), F.col("source_id")).alias("city"), F.array_join(F.array_compact(F.array(F.when(~F.coalesce(S.present(F.col("city")), F.lit(False)), "city"), F.when(F.col("url").isNull(), "url"))), ",").alias("filled")),
    "extraction_gate": lambda s, d: extraction_gate(view(s, d, "pages_v").select("id", "status", (100 - 10 * (F.col("id") % 5)).alias("confidence"), F.sha2("html", 256).alias("content_hash")), view(s, d, "pages_v").where("id % 3 <> 0").select("id", F.sha2(F.when(F.col("id") % 3 == 1, F.col("html")).otherwise(F.concat("html", F.lit(" "))), 256).alias("content_hash"))),
    "extract_to_records": lambda s, d: view(s, d, "pages_v").select("id", F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"), "source_id").withColumn("state", F.when(F.col("title").isNull(), "error").otherwise("record")),
    "seed_rows": lambda s, d: view(s, d, "sources_v").select("id", F.explode(F.array_distinct(F.concat(F.array(U.normalize_url(F.col("url"))), U.expand_urls(F.concat("url", F.lit("/{letter}")), F.array(*map(F.lit, "abb")))))).alias("seed")),
    "nav_sections": lambda s, d: extract_links(view(s, d, "pages_v")).select("source_id", U.section_type(F.lit(""), F.col("target")).alias("section"), U.section_pagination(F.col("target")).alias("pagination"), "target").groupBy("source_id", "section").agg(F.min("target").alias("url"), F.min("pagination").alias("pagination"), F.count("*").alias("links")),
}

_Q = U.LINK.replace("'", "''")
_OWN = "case when regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) end"


def _no_dots(p):
    """Dot parts are folded part by part; written for this SQL only."""
    fold = f"list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') when x = '.' then a else a || '/' || x end)"
    return f"case when regexp_matches({p}, '(^|/)[.][.]?$') then {fold} || '/' when {fold} = '' then '/' else {fold} end"


_LINKS = f"""w as (select id, url, source_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>', ' ', 'g'), '{_Q}', 1) as found, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as root, {_OWN} as own from pages_v),
    u as (select id, url, source_id, root, own, unnest(found) as raw, unnest(range(len(found))) as pos from w),
    l as (select *, regexp_replace(trim(replace(regexp_replace(raw, '^["'']|["'']$', '', 'g'), '&amp;', '&')), '#.*$', '') as link from u),
    m as (select *, regexp_extract(link, '^([^?]*)', 1) as aim, regexp_extract(link, '([?].*)$', 1) as rest, regexp_extract(own, '^(.*/)', 1) || regexp_extract(link, '^([^?]*)', 1) as below from l),
    t as (select id, source_id, cast(pos as int) as pos, case when link = '' then null when regexp_matches(link, '(?i)^https?://') then link when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with(link, '//') then regexp_extract(url, '^([A-Za-z]+:)', 1) || link
        when starts_with(link, '?') then root || own || link when starts_with(link, '/') then root || {_no_dots('aim')} || rest else root || {_no_dots('below')} || rest end as target from m),
    k as (select * from t where target is not null and lower(regexp_extract(target, '^[A-Za-z]+://([^/:?#]+)', 1)) = source_id)"""
_TP = "regexp_extract(target, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_CLEAN = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _t in ("script", "style", "nav", "footer", "noscript", "iframe"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?s)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"
ORACLE = {k: with_views(v) for k, v in {
    "extract_links": f"with {_LINKS} select id, source_id, pos, target from k",
    "discover_frontier": f"with {_LINKS}, n as (select source_id, target, min(id) as found_on, arg_min(id % 4, id) as depth from k where id % 4 < 3 group by 1, 2), y as (select *, case {_when(f'lower({_TP})', [(k, '/' + w) for w, k in U.DETAIL])} when {_any(f'lower({_TP})', ['/' + w for w in U.UTILITY])} then 'utility' else 'generic' end as page_type from n where not exists (select 1 from pages_v p where p.source_id = n.source_id and p.url = target)) select source_id, target, found_on, cast(depth + 1 as int) as depth, page_type, case page_type when 'utility' then 5 when 'generic' then 30 else 80 end as priority from y",
    "directory_expand": f"with {_LINKS}, q as (select distinct source_id, target, list_filter(string_split({_TP}, '/'), lambda x: x <> '') as parts from k) select source_id, target from q where len(parts) = 1 and not contains(lower(parts[1]), '.') and lower(parts[1]) not in ('en', 'is', 'the')",
    "regex_extract": "select page_id, nullif(regexp_extract(html, '<h1[^>]*>([^<]+)</h1>', 1), '') as heading, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') as lang from pages",
    "classify_pages": "with p as (select id, url, lower(html) as h, regexp_extract(html, '\"@type\"\\s*:\\s*\"([A-Za-z]+)\"', 1) as ld from pages_v), q as (select id, case ld " + " ".join(f"when '{n}' then '{k}'" for n, k in U.LD_TYPES.items()) + " end as a, case " + " ".join(f"when regexp_matches(url, '(?i){x}') then '{k}'" for x, k in U.PAGE_TYPES) + f" end as b, case when contains(h, '{DIRECTORY_TEXT}') then 'artist_directory_letter' when " + " and ".join(f"regexp_matches(h, '>\\s*{x}\\s*</a>')" for x in HUB_LABELS) + " then 'artist_profile_hub' end as c from p) select id, coalesce(a, b, c, 'unknown') as page_type, case when a is not null then 95 when b is not null then 75 when c is not null then 80 else 0 end as confidence from q",
    "date_signal": "select page_id, cast(len(regexp_extract_all(html, '([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})', 1)) as int) as dates from pages",
    "clean_html": f"select page_id, trim(regexp_replace(regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as body from pages",
    "child_records": "with i as (select id, source_id, title as item from records_v union all select id, source_id, nationality from records_v), f as (select sha1(source_id || '|' || item) as fingerprint, arg_min(item, id) as title, min(id) as parent_id from i where item is not null group by 1) select * from f where fingerprint not in (select sha1(source_id || '|' || title) from records_v where status = 'approved')",
    "backfill_merge": "select id, coalesce(case when coalesce(trim(city), '') not in ('', '[]', '{}') then city end, source_id) as city, array_to_string(list_filter([case when coalesce(trim(city), '') in ('', '[]', '{}') then 'city' end, case when url is null then 'url' end], lambda x: x is not null), ',') as filled from records_v",
    "extraction_gate": "select id, case when id % 3 = 1 then 'unchanged' when status = 'error' or id % 5 > 2 then 'review' else 'persist' end as route, case when id % 3 = 1 then null when status = 'error' then 'fetch_error' when id % 5 > 2 then 'low_confidence' end as reason from pages_v",
    "extract_to_records": "with p as (select id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') as title, source_id from pages_v) select *, case when title is null then 'error' else 'record' end as state from p",
    "seed_rows": "select id, unnest([url || '/', url || '/a', url || '/b']) as seed from sources_v",
    "nav_sections": f"with {_LINKS}, s as (select source_id, target, lower(target) as n from k), y as (select source_id, target, case {' '.join(f'when {_any(chr(110), w)} then {k!r}' for k, w in U.SECTIONS)} else 'unknown' end as section, case {_when('n', U.PAGINATION)} else 'none' end as pagination from s) select source_id, section, min(target) as url, min(pagination) as pagination, count(*) as links from y group by 1, 2",
}.items()}
