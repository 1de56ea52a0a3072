"""Ranked search of many queries over vectors, in blocks: the best k of each query from every block, ranked together.

Rows and queries are dealt to blocks by a hash, and each pair of blocks is one matrix product. A block gives, for each of its
queries, what may be among the best k by the product's rounding; the exact score decides between those.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.sources.views import view, with_views

BLOCK = 4096
#: More than scores of a matrix product can differ from exact ones after rounding to 6 places.
SLACK = 3e-6


def unit_rows(column, dim: int) -> np.ndarray:
    """Vectors of this length as rows of length one; zeros for all others."""
    out = np.zeros((len(column), dim))
    for i, e in enumerate(column.to_pylist()):
        if e is not None and len(e) == dim and None not in e:
            v = np.array(e, float)
            n = np.linalg.norm(v)
            if n > 0 and np.isfinite(n):
                out[i] = v / n
    return out


class Sets:
    """A column of lists as numbered sets; rows with equal sets share a number."""

    def __init__(self, column: pa.ChunkedArray):
        known: dict[frozenset, int] = {}
        self.of = np.array([known.setdefault(frozenset(x or ()), len(known)) for x in column.to_pylist()], int)
        self.sets = list(known)

    def overlap(self, i: np.ndarray, j: np.ndarray, other: Sets | None = None) -> np.ndarray:
        """Jaccard similarity of rows i and of rows j, of the other column if it is given; 0 if both are empty."""
        sides = [(s.sets, *np.unique(s.of[x], return_inverse=True)) for s, x in ((self, i), (other or self, j))]
        (a, at_a), (b, at_b) = (([sets[k] for k in found], at) for sets, found, at in sides)
        place = {w: n for n, w in enumerate(set().union(*a) & set().union(*b))}
        has = [np.zeros((len(x), len(place))) for x in (a, b)]
        for x, m in zip((a, b), has, strict=True):
            for k, s in enumerate(x):
                m[k, [place[w] for w in s if w in place]] = 1
        both = has[0] @ has[1].T
        size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
        return (both / np.maximum(size, 1))[at_a][:, at_b]


def _place_test(location: str):
    """Whether a text holds the location, case aside, with % and _ as wildcards."""
    low = location.lower()
    if "%" not in low and "_" not in low:
        return lambda place: low in place
    pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in low), re.DOTALL)
    return lambda place: pattern.search(place) is not None


def _best_of_block(k: int):
    def work(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, bonus = rows["id"].to_numpy(), rows["bonus"].to_numpy(zero_copy_only=False)
        names, locations = queries["query"].to_pylist(), queries["location"].to_pylist()
        sizes = np.array([len(e or ()) for e in queries["embedding"].to_pylist()])
        places = [[p.lower() for p in x or () if p is not None] for x in rows["places"].to_pylist()] if any(locations) else []
        out_query, out_id = [], []
        by_id = np.argsort(ids, kind="stable")
        for dim in np.unique(sizes) if rows.num_rows else ():
            own = np.flatnonzero(sizes == dim)
            unit = unit_rows(rows["embedding"], dim) if dim else None
            asked = unit_rows(queries["embedding"].take(pa.array(own)), dim) if dim else None
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                values = (asked[at : at + 256] @ unit.T if dim else np.zeros((len(part), len(ids)))) + bonus
                for q, value in zip(part.tolist(), values, strict=True):
                    keep = by_id
                    if locations[q]:
                        fits = _place_test(locations[q])
                        keep = keep[np.array([any(map(fits, places[i])) for i in keep.tolist()], bool)]
                    if len(keep) > k:
                        keep = keep[value[keep] >= np.partition(value[keep], -k)[-k] - SLACK]
                        keep = keep[np.argsort(-value[keep], kind="stable")]
                        run = np.flatnonzero(np.diff(value[keep], prepend=np.inf))  # of rows of one value the k of least id
                        keep = keep[np.arange(len(keep)) - np.repeat(run, np.diff(np.r_[run, len(keep)])) < k]
                    out_query += [names[q]] * len(keep)
                    out_id.append(ids[keep])
        return pa.table({"query": pa.array(out_query, pa.int64()), "id": np.concatenate([np.zeros(0, np.int64), *out_id])})

    return work


def top_k(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, place, id, score): for each query the k rows of highest cosine plus bonus, rounded to 6 places, then of least id.

    rows: id (unique), embedding, bonus, places; queries: query (unique), embedding, location. Vectors that are missing, zero or of another length than the query's have cosine 0.
    A query with a location only finds rows one of whose places holds it.
    """
    n_rows, n_queries = (max(1, math.ceil(df.count() / block)) for df in (rows, queries))
    deal = lambda df, own, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(own), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    a = deal(rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("bonus").cast("double").alias("bonus"), "places"), "id", "rb", n_rows, "qb", n_queries)
    b = deal(queries.select("query", F.col("embedding").cast("array<double>").alias("embedding"), "location"), "query", "qb", n_queries, "rb", n_rows)
    near = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInArrow(_best_of_block(k), "query long, id long")
    exact = near.join(rows.select("id", F.col("embedding").alias("e"), "bonus"), "id").join(queries.select("query", F.col("embedding").alias("q")), "query")
    scored = exact.select("query", "id", F.round(F.coalesce(S.cosine_similarity(F.col("e"), F.col("q")), F.lit(0.0)) + F.col("bonus"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query", "place", "id", "score")


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


PLACES = ("city", "country", "venue_name", "venue_address", "nationality")


def _with_places(records: DataFrame) -> DataFrame:
    return records.withColumn("places", F.array(*[F.col(c).cast("string") for c in PLACES if c in records.columns]))


def semantic_artists(records: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The best artists of each query: cosine, a thousandth of the completeness, and of the confidence up to 0.1."""
    artists = records.where(F.col("record_type") == "artist").withColumn("bonus", _number("completeness_score") / 1000 + F.least(_number("confidence_score") / 1000, F.lit(0.1)))
    return top_k(_with_places(artists), queries, k)


def semantic_exhibitions(records: DataFrame, queries: DataFrame, now: str, k: int = 20, days: int = 120) -> DataFrame:
    """The best exhibitions of each query: cosine, a thousandth of the completeness, and 0.05 for those less than so many days old."""
    fresh = F.coalesce(F.floor((F.unix_timestamp(F.expr(now)) - F.unix_timestamp("created_at")) / 86400) < days, F.lit(False))
    shows = records.where(F.col("record_type") == "exhibition").withColumn("bonus", F.when(fresh, 0.05).otherwise(0.0) + _number("completeness_score") / 1000)
    return top_k(_with_places(shows), queries, k)


def ask(records: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """(query, intent, location, place, id, score): each question (query, text) answered by the artists nearest to its words.

    What follows the last " in " is a place that answers must be at; "similar" anywhere makes it a question for similar artists. Questions that find nothing have one row without an answer.
    """
    low = F.lower("text")
    named = F.when(F.contains(F.col("text"), F.lit(" in ")), F.regexp_extract("text", "(?s)^.* in (.*)$", 1)).otherwise(F.col("text"))
    location = F.when(F.contains(low, F.lit(" in ")), F.nullif(F.trim(named), F.lit("")))
    asked = questions.select("query", F.when(F.contains(low, F.lit("similar")), "artist_similarity").otherwise("semantic_lookup").alias("intent"), location.alias("location"), S.hash_embedding(F.col("text")).alias("embedding"))
    return asked.select("query", "intent", "location").join(semantic_artists(records, asked, k), "query", "left")


NOW = "timestamp '2024-05-01 00:00:00'"


def _records(s, d):
    """Records with the vector of the same id; their update is taken for their creation."""
    r = view(s, d, "records_v").select("id", "record_type", "city", F.col("source_id").alias("country"), "nationality", "completeness_score", "confidence_score", F.col("updated_at").cast("timestamp").alias("created_at"))
    return r.join(view(s, d, "vectors_v").select("id", "embedding"), "id")


def _queries(s, d):
    """All vectors whose id is divisible by 100; every third asks for a place."""
    return view(s, d, "vectors_v").where("id % 100 = 0").select(F.col("id").alias("query"), "embedding", F.when(F.col("id") % 300 == 0, "rc1").alias("location"))


def _told(s, d):
    return view(s, d, "records_v").select("id", "record_type", "city", F.col("source_id").alias("country"), "nationality", "completeness_score", "confidence_score", S.hash_embedding(F.col("description")).alias("embedding"))


QUERIES = {
    "semantic_artists": lambda s, d: semantic_artists(_records(s, d), _queries(s, d)),
    "semantic_exhibitions": lambda s, d: semantic_exhibitions(_records(s, d), _queries(s, d), NOW),
    "ask": lambda s, d: ask(_told(s, d), view(s, d, "conversations").where("conv_id % 100 = 0").select((F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("query"), "text")),
}

_COS = "list_cosine_similarity(v.embedding::double[], q.embedding::double[])"
_FIND = "(q.id % 300 <> 0 or coalesce(city, '') ilike '%rc1%' or source_id ilike '%rc1%' or nationality ilike '%rc1%')"


def _ranked(kind: str, bonus: str) -> str:
    return f"with s as (select q.id as query, r.id, round({_COS} + {bonus}, 6) as score from records_v r join vectors_v v on v.id = r.id join vectors_v q on q.id % 100 = 0 where record_type = '{kind}' and {_FIND}), p as (select query, row_number() over (partition by query order by score desc, id)::int as place, id, score from s) select query, place, id, score from p where place <= 20"


def _hashed(text: str) -> str:
    buckets = f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: (('0x' || substr(sha256(w), 1, 8))::ubigint % 96)::int)"
    return f"list_transform(range(96), lambda i: len(list_filter({buckets}, lambda y: y = i))::double)"


ORACLE = {k: with_views(v) for k, v in {
    "semantic_artists": _ranked("artist", "completeness_score / 1000 + least(confidence_score / 1000, 0.1)"),
    "semantic_exhibitions": _ranked("exhibition", f"case when floor(epoch({NOW} - updated_at) / 86400) < 120 then 0.05 else 0 end + completeness_score / 1000"),
    "ask": f"""with a as (select id, city, source_id, nationality, completeness_score / 1000 + least(confidence_score / 1000, 0.1) as bonus, {_hashed('description')} as c from records_v where record_type = 'artist'),
        b as (select *, list_transform(c, lambda x: round(x / coalesce(nullif(sqrt(list_inner_product(c, c)), 0), 1), 6)) as e from a),
        t as (select conv_id::bigint * 1000 + turn as query, text, {_hashed('text')} as c from conversations where conv_id % 100 = 0),
        q as (select query, case when contains(lower(text), 'similar') then 'artist_similarity' else 'semantic_lookup' end as intent, case when contains(lower(text), ' in ') then nullif(trim(case when contains(text, ' in ') then regexp_extract(text, '(?s)^.* in (.*)$', 1) else text end), '') end as location,
              list_transform(c, lambda x: round(x / coalesce(nullif(sqrt(list_inner_product(c, c)), 0), 1), 6)) as f from t),
        s as (select query, id, round(coalesce(list_inner_product(e, f) / nullif(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(f, f)), 0), 0) + bonus, 6) as score from b join q on location is null or city ilike '%' || location || '%' or source_id ilike '%' || location || '%' or nationality ilike '%' || location || '%'),
        p as (select *, row_number() over (partition by query order by score desc, id)::int as place from s)
        select q.query, intent, location, place, id, score from q left join p on p.query = q.query and place <= 20""",
}.items()}
