"""Windows, top-k and ordering. Every order ends in an id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.operators.search import BLOCK, Sets, unit_rows
from loomscan.sources.views import view, with_views

#: More than the width of a score rounded to 5 places, of which equal ones are ranked by id.
SLACK = 1.2e-5
NOW = "timestamp '2024-01-01 03:00:00'"


def latest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The last row of each group: a partial aggregate, no sort of whole groups."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def adjacent(df: DataFrame, by: str, order: str = "id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def frontier_due(frontier: DataFrame, now: str, per_run: int) -> DataFrame:
    """Queued or retryable rows whose time has come: both times null, or either passed; by priority, depth, age."""
    t = F.expr(now)
    due = (F.col("next_retry_at").isNull() & F.col("next_eligible_at").isNull()) | F.coalesce(F.col("next_retry_at") <= t, F.lit(False)) | F.coalesce(F.col("next_eligible_at") <= t, F.lit(False))
    w = Window.partitionBy("source_id").orderBy(F.desc("priority"), "depth", "created_at", "id")
    return frontier.where(F.col("status").isin("queued", "failed_retryable") & due).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_run)


def politeness_schedule(frontier: DataFrame, now: str, seconds: int) -> DataFrame:
    """The earliest slot of each URL at one request in so many seconds a host."""
    w = Window.partitionBy("source_id").orderBy(F.desc("priority"), "id")
    return frontier.withColumn("slot", F.expr(now) + F.make_interval(secs=(F.row_number().over(w) - 1) * seconds))


def field_vote(votes: DataFrame, by: list[str]) -> DataFrame:
    """The value of greatest summed weight in each group, ties to the least value."""
    total = votes.groupBy(*by, "value").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return total.groupBy(*by).agg(F.min_by(F.struct("value", "weight"), F.struct(-F.col("weight"), "value")).alias("b")).select(*by, "b.value", "b.weight")


def top_failing_fields(signals: DataFrame, k: int = 10) -> DataFrame:
    """(source_id, place, field, n): the k fields of each source that have the most signals, ties by name. Signals without a field count for none."""
    counted = signals.where("field <> ''").groupBy("source_id", "field").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "field"))
    return counted.withColumn("place", place).where(F.col("place") <= k).select("source_id", "place", "field", "n")


def template_match(items: DataFrame, templates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The best template of each item at or above the threshold, ties to the earlier one.

    0.35 equal type, 0.25 equal system, 0.25 of the template's entity types that the item has, 0.15 of its pattern tokens that
    the item's patterns hold. Without an equal type or system 0.4 is the most, so that thresholds over it need only those pairs.
    """
    if threshold <= 0.4:
        raise ValueError("thresholds up to 0.4 need neither type nor system")
    met = items.join(templates, items["kind"] == templates["t_kind"]).unionByName(items.join(templates, (items["system"] == templates["t_system"]) & ~items["kind"].eqNullSafe(templates["t_kind"])))
    share = lambda found, of: F.coalesce(found / F.nullif(F.size(of), F.lit(0)), F.lit(0.0))
    words = share(F.size(F.array_intersect("words", "t_words")), "t_words")
    tokens = share(F.size(F.filter("t_tokens", lambda t: F.contains(F.lower("patterns"), F.lower(t)))), "t_tokens")
    same = lambda a, b, w: F.when(F.col(a) == F.col(b), w).otherwise(0.0)
    score = F.round(same("kind", "t_kind", 0.35) + same("system", "t_system", 0.25) + 0.25 * words + 0.15 * tokens, 4)
    scored = met.select("id", "template", score.alias("score")).where(F.col("score") >= threshold)
    return scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("template")).alias("neg"))).alias("b")).select("id", (-F.col("b.neg")).alias("template"), F.col("b.score").alias("score"))


def stuck(jobs: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Running jobs that were silent for so long, with the row that resets them."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") < F.expr(f"{as_of} - interval '{minutes}' minute"))).select("id", F.lit("pending").alias("status"), (F.col("attempts") + 1).alias("attempts"))


def stuck_work(jobs: DataFrame, frontier: DataFrame, pages: DataFrame, as_of: str, minutes: int = 2, page_seconds: int = 900) -> DataFrame:
    """(kind, id, status, tries, reason) that resets silent jobs, leases past their end (tries: the next lease version) and pages in progress for too long."""
    j = stuck(jobs, as_of, minutes).select(F.lit("job").alias("kind"), "id", "status", F.col("attempts").alias("tries"), F.lit("no_heartbeat").alias("reason"))
    f = frontier.where((F.col("status") == "fetching") & (F.col("lease_expires_at") < F.expr(as_of))).select(F.lit("frontier"), "id", F.lit("queued"), F.col("lease_version") + 1, F.lit("lease_expired_reset_to_queue"))
    p = pages.where((F.col("status") == "in_progress") & (F.col("started_at") < F.expr(f"{as_of} - interval '{page_seconds}' second"))).select(F.lit("page"), "id", F.lit("pending"), F.lit(None).cast("int"), F.lit("recovered_from_stale_in_progress"))
    return j.union(f).union(p)


def requeue(frontier: DataFrame, now: str, limit: int) -> DataFrame:
    """The oldest discovered rows of each source become queued; retryable rows become queued with now as retry time.

    Only discovered rows are ranked, and the first `limit` of each task's before any of a source meet.
    """
    w = Window.partitionBy("source_id").orderBy("created_at", "id")
    first = frontier.where("status = 'discovered'").select("id", "source_id", "created_at").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("id", F.lit(True).alias("_first"))
    moved = F.col("_first").isNotNull() | (F.col("status") == "failed_retryable")
    out = frontier.join(first, "id", "left")
    return out.select("id", F.when(moved, "queued").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "failed_retryable", F.expr(now)).otherwise(F.col("next_retry_at")).alias("next_retry_at"))


RELATED = ("exhibitions", "articles", "press")


def related_overlap(left: str, right: str) -> Column:
    """Mean overlap of the three related lists; a missing or empty list counts as none shared."""
    one = lambda c: F.when((F.size(f"{left}{c}") > 0) & (F.size(f"{right}{c}") > 0), S.jaccard(F.col(f"{left}{c}"), F.col(f"{right}{c}"))).otherwise(0.0)
    return F.least(sum((one(c) for c in RELATED), F.lit(0.0)) / 3, F.lit(1.0))


def place_text(side: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(f"{side}{c}", F.lit("")) for c in ("city", "country", "nationality")]))


def location_similarity(left: str, right: str) -> Column:
    """1 for equal places (city, country, nationality as one text), 0.5 for the same country, else 0."""
    a, b = place_text(left), place_text(right)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.col(f"{left}country") == F.col(f"{right}country"), 0.5).otherwise(0.0)


def related_artists(artists: DataFrame, anchors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """For each anchor the k others of highest 0.6 cosine + 0.25 related overlap + 0.15 location, above 0; of equal ones those of least id.

    Artists and anchors are dealt to blocks, and each pair of blocks is compared in its own task, which gives the anchors' best by what a
    product can differ; the exact score of those decides.
    """
    names = ["embedding", "city", "country", "nationality", *RELATED]
    n_artists, n_anchors = (max(1, math.ceil(df.count() / block)) for df in (artists, anchors))
    deal = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    placed = lambda df: df.select("id", "embedding", place_text("").alias("place"), "country", *RELATED)
    a, q = deal(placed(artists), "ab", n_artists, "qb", n_anchors), deal(placed(anchors), "qb", n_anchors, "ab", n_artists)
    near = a.groupBy("qb", "ab").cogroup(q.groupBy("qb", "ab")).applyInArrow(_most_related(k), "anchor long, id long")
    exact = near.join(artists.select("id", *names), "id").join(anchors.select(F.col("id").alias("anchor"), *[F.col(c).alias(f"a_{c}") for c in names]), "anchor")
    score = F.round(0.6 * S.cosine_similarity(F.col("embedding"), F.col("a_embedding")) + 0.25 * related_overlap("", "a_") + 0.15 * location_similarity("", "a_"), 5)
    scored = exact.select("anchor", "id", score.alias("score")).where("score > 0")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)


def _most_related(k: int, tile: int = 256):
    """(anchor, id) of one pair of blocks: for each anchor whatever may be among its k best, of rows of one value the k of least id."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, asked = rows["id"].to_numpy(), anchors["id"].to_numpy()
        sizes = np.array([len(e or ()) for e in anchors["embedding"].to_pylist()], int)
        lists = {c: (Sets(rows[c]), Sets(anchors[c])) for c in RELATED}
        (place, a_place), (country, a_country) = (_codes(rows[c], anchors[c]) for c in ("place", "country"))
        empty = np.array([p == "" for p in rows["place"].to_pylist()], bool)
        a_empty = np.array([p == "" for p in anchors["place"].to_pylist()], bool)
        found, of = [], []
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            unit, q_unit = (unit_rows(t["embedding"], dim) for t in (rows, anchors.take(pa.array(own)))) if dim else (np.zeros((len(ids), 1)), np.zeros((len(own), 1)))
            for at in range(0, len(own), tile):
                part = own[at : at + tile]
                every = np.arange(len(ids))
                related = np.minimum(sum((y.overlap(part, every, x) for x, y in lists.values()), 0.0) / 3, 1.0)
                same_country = (a_country[part][:, None] == country[None, :]) & (country >= 0)[None, :]
                located = np.where(a_place[part][:, None] == place[None, :], 1.0, np.where(same_country, 0.5, 0.0)) * ~(a_empty[part][:, None] | empty[None, :])
                values = 0.6 * (q_unit[at : at + tile] @ unit.T) + 0.25 * related + 0.15 * located
                values[asked[part][:, None] == ids[None, :]] = -1
                for q, value in zip(asked[part].tolist(), values, strict=True):
                    keep = np.flatnonzero(value > -SLACK)
                    if len(keep) > k:
                        keep = keep[value[keep] >= np.partition(value[keep], -k)[-k] - SLACK]
                        keep = keep[np.argsort(-value[keep], kind="stable")]
                        run = np.flatnonzero(np.diff(value[keep], prepend=np.inf))
                        keep = keep[np.arange(len(keep)) - np.repeat(run, np.diff(np.r_[run, len(keep)])) < k]
                    found.append(ids[keep])
                    of.append(np.full(len(keep), q, np.int64))
        none = np.zeros(0, np.int64)
        return pa.table({"anchor": np.concatenate([none, *of]), "id": np.concatenate([none, *found])})

    return work


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Texts of several columns as numbers, equal for equal texts; null is -1."""
    known: dict[str, int] = {}
    return [np.array([-1 if x is None else known.setdefault(x, len(known)) for x in c.to_pylist()], int) for c in columns]


def _artists(s, d):
    """Vectors with the places and lists of the record of the same id."""
    r = view(s, d, "records_v").select("id", "city", F.col("source_id").alias("country"), "nationality", F.array("record_type").alias("exhibitions"), F.array("nationality", "record_type").alias("articles"), F.array().cast("array<string>").alias("press"))
    return view(s, d, "vectors_v").select("id", "embedding").join(r, "id")


def _items(e):
    return e.select("id", F.col("entity_type").alias("kind"), F.col("city").alias("system"), S.tokens(F.col("name")).alias("words"), F.col("name").alias("patterns"))


TEMPLATES = [(0, "PROMO", "Brand#1", ["old", "bolt"], ["ol", "x"]), (1, "STANDARD", "Brand#2", ["small", "ring"], ["ring"]), (2, "ECONOMY", "Brand#3", ["new"], ["n", "e"]), (3, "PROMO", "Brand#2", ["small"], [])]


def _templates(s):
    return s.createDataFrame(TEMPLATES, "template int, t_kind string, t_system string, t_words array<string>, t_tokens array<string>")


def _votes(l):
    return l.select("entity_id", F.lit("source").alias("field"), F.col("source_id").alias("value"), F.col("confidence").alias("weight"))


QUERIES = {
    "latest_record_per_page": lambda s, d: latest(view(s, d, "records_v").select((F.col("id") % 77).alias("page"), "id", "updated_at", "title"), ["page"], "updated_at", "id"),
    "adjacent_records": lambda s, d: adjacent(view(s, d, "records_v").where("status = 'approved'").select("id", "source_id"), "source_id"),
    "frontier_due": lambda s, d: frontier_due(view(s, d, "frontier_v"), NOW, 3).select("id", "source_id", "place"),
    "politeness_schedule": lambda s, d: politeness_schedule(view(s, d, "frontier_v"), NOW, 5).select("id", "slot"),
    "related_artists": lambda s, d: related_artists(_artists(s, d), _artists(s, d).where("id % 100 = 0"), 10),
    "field_vote": lambda s, d: field_vote(_votes(view(s, d, "links_v")), ["entity_id", "field"]),
    "template_match": lambda s, d: template_match(_items(view(s, d, "entities_v")), _templates(s)),
    "top_failing_fields": lambda s, d: top_failing_fields(view(s, d, "signals_v")),
    "stuck_work": lambda s, d: stuck_work(view(s, d, "jobs_v").withColumn("heartbeat_at", F.expr("heartbeat_at + interval '9000' day")), view(s, d, "frontier_v").withColumn("status", F.when(F.col("status") == "fetched", "fetching").otherwise(F.col("status"))).withColumn("lease_expires_at", F.expr("created_at + interval '5' minute")).withColumn("lease_version", F.col("depth")), view(s, d, "pages_v").withColumn("status", F.when(F.col("status") == "pending", "in_progress").otherwise(F.col("status"))).withColumn("started_at", F.col("fetched_at")), "timestamp '2024-01-01 01:00:00'"),
    "requeue": lambda s, d: requeue(view(s, d, "frontier_v"), NOW, 1),
}

_COS = "list_cosine_similarity(v.embedding::double[], q.embedding::double[])"
ORACLE = {k: with_views(v) for k, v in {
    "latest_record_per_page": "select id % 77 as page, max(id) as id, max(updated_at) as updated_at, arg_max(title, id) as title from records_v group by 1",
    "adjacent_records": "select id, source_id, lag(id) over w as previous, lead(id) over w as next from records_v where status = 'approved' window w as (partition by source_id order by id)",
    "frontier_due": f"with f as (select id, source_id, row_number() over (partition by source_id order by priority desc, depth, created_at, id) as place from frontier_v where status in ('queued', 'failed_retryable') and ((next_retry_at is null and next_eligible_at is null) or coalesce(next_retry_at <= {NOW}, false) or coalesce(next_eligible_at <= {NOW}, false))) select id, source_id, cast(place as int) as place from f where place <= 3",
    "politeness_schedule": f"select id, {NOW} + (row_number() over (partition by source_id order by priority desc, id) - 1) * interval '5' second as slot from frontier_v",
    "related_artists": f"with w as (select v.id, embedding, city, source_id as country, nationality, record_type, lower(concat_ws(' ', nullif(city, ''), source_id, nationality)) as place from vectors_v v join records_v r on r.id = v.id), x as (select q.id as anchor, v.id, round(0.6 * {_COS} + 0.25 * (case when v.record_type = q.record_type then 1 else 0 end + (case when v.nationality = q.nationality then 1 else 0 end + case when v.record_type = q.record_type then 1 else 0 end) / (4 - case when v.nationality = q.nationality then 1 else 0 end - case when v.record_type = q.record_type then 1 else 0 end)) / 3 + 0.15 * case when v.place = q.place then 1 when v.country = q.country then 0.5 else 0 end, 5)::double as score from w v, w q where q.id % 100 = 0 and v.id <> q.id), y as (select *, row_number() over (partition by anchor order by score desc, id) as place from x where score > 0) select anchor, id, score, cast(place as int) as place from y where place <= 10",
    "field_vote": "with t as (select entity_id, source_id as value, round(sum(confidence), 6) as weight from links_v group by 1, 2), r as (select *, row_number() over (partition by entity_id order by weight desc, value) as n from t) select entity_id, 'source' as field, value, weight from r where n = 1",
    "template_match": "with t(template, k, s, w, p) as (values " + ", ".join(f"({n}, '{k}', '{y}', {w}::varchar[], {p}::varchar[])" for n, k, y, w, p in TEMPLATES) + "), x as (select id, template, round(case when entity_type = k then 0.35 else 0 end + case when city = s then 0.25 else 0 end + 0.25 * coalesce(len(list_intersect(regexp_split_to_array(lower(name), '[^a-z0-9]+'), w)) / nullif(len(w), 0), 0) + 0.15 * coalesce(len(list_filter(p, lambda z: contains(lower(name), z))) / nullif(len(p), 0), 0), 4)::double as score from entities_v, t), y as (select *, row_number() over (partition by id order by score desc, template) as n from x where score >= 0.75) select id, template, score from y where n = 1",
    "top_failing_fields": "with c as (select source_id, field, count(*) as n from signals_v where field <> '' group by 1, 2), p as (select source_id, row_number() over (partition by source_id order by n desc, field)::int as place, field, n from c) select source_id, place, field, n from p where place <= 10",
    "stuck_work": "select 'job' as kind, id, 'pending' as status, attempts + 1 as tries, 'no_heartbeat' as reason from jobs_v where status = 'running' and heartbeat_at + interval '9000' day < timestamp '2024-01-01 00:58:00' union all select 'frontier', id, 'queued', depth + 1, 'lease_expired_reset_to_queue' from frontier_v where status = 'fetched' and created_at < timestamp '2024-01-01 00:55:00' union all select 'page', id, 'pending', null, 'recovered_from_stale_in_progress' from pages_v where status = 'pending' and fetched_at < timestamp '2024-01-01 00:45:00'",
    "requeue": f"with f as (select *, row_number() over (partition by source_id, status order by created_at, id) as n from frontier_v) select id, case when (status = 'discovered' and n <= 1) or status = 'failed_retryable' then 'queued' else status end as status, case when status = 'failed_retryable' then {NOW} else next_retry_at end as next_retry_at from f",
}.items()}
