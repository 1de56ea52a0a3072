"""Like names without loss: an exact similarity join on distinct names, and the matching rules that stand on it.

The string ratio of two names is twice their matching characters over their lengths, so a ratio of t needs at least
t(|a| + |b|)/2 characters in common, counted with repeats. Each name is a set of (character, occurrence) marks in one global
order, rarest first; names that can reach t must share one of their first marks (as many as the bound leaves over) and lie
in neighbouring length classes. Those two are the join keys. What is left is counted exactly, and only then compared.

Rows are folded to classes of equal names and fields before any pair is formed; answers are joined back to all rows. A rule
that needs a total score gives each pattern of equal fields its own least ratio, with these fields as further join keys.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomscan.functions import scores as S
from loomscan.functions.gestalt import sequence_ratio
from loomscan.operators.entities import clusters, resolve, winners
from loomscan.plans.shared import materialize
from loomscan.sources.views import view, with_views

#: Marks beyond the commonest so many count as rare in the order; the order decides speed only, not results.
RANKED = 4096

#: The fields of a record type that are compared beside the name of an entity; the share of equal ones counts. Types without fields score 0.
SECONDARY = {"artist": ("birth_year", "nationality"), "artwork": ("medium", "year"), "exhibition": ("venue_name", "start_date"), "event": ("venue_name", "start_date"), "venue": ("address",)}
#: The fields of a record type that are compared beside the name of a stored record, and those whose equality allows a merge.
IDENTITY = {
    "artist": ("birth_year", "website_url", "instagram_url", "email", "nationality"), "venue": ("address", "city", "country", "phone", "website_url"), "event": ("start_date", "end_date", "venue_name", "ticket_url", "source_url"),
    "exhibition": ("start_date", "end_date", "venue_name", "curator", "source_url"), "artwork": ("year", "medium", "dimensions", "price", "source_url"), "organization": ("website_url", "address", "city", "country", "phone", "source_url"),
}
STRONG = {
    "artist": ("website_url", "instagram_url", "email", "birth_year"), "venue": ("address", "phone", "website_url"), "event": ("ticket_url", "source_url"),
    "exhibition": ("source_url", "venue_name"), "artwork": ("source_url", "dimensions", "year"), "organization": ("website_url", "address", "phone", "source_url"),
}
#: The fields of entities whose share of equal values counts beside the name.
OVERLAP = ("birth_year", "nationality", "venue_name", "start_date", "address", "city", "country", "year", "medium")


def _marks(name: str) -> list[str]:
    return [f"{c}{k}" for c, n in Counter(name).items() for k in range(n)]


def _marked(threshold: float, rank: dict[str, int]) -> Column:
    """Of a column `name` all marks, and the first ones in the order, of which a like name must have one."""

    @F.pandas_udf("every array<string>, first array<string>")
    def marked(names: pd.Series) -> pd.DataFrame:
        out = []
        for name in names:
            every = _marks(name)
            needed = math.ceil(len(every) * threshold / (2 - threshold) - 1e-9)
            out.append((every, sorted(every, key=lambda m: (rank.get(m, -1), m))[: len(every) - needed + 1]))
        return pd.DataFrame(out, columns=["every", "first"])

    return marked(F.col("name"))


@F.pandas_udf(ArrayType(StringType()))
def _all_marks(names: pd.Series) -> pd.Series:
    return names.map(_marks)


def similar_names(left: DataFrame, right: DataFrame, on: list[str], threshold: float, ordered: bool = False) -> DataFrame:
    """(on, l_name, r_name, ratio): the distinct names of rows with equal, non-null `on` whose string ratio, left to right, reaches the threshold (0 < threshold <= 1).

    Null and empty names are in no pair. Equal names have ratio 1. ordered: only pairs whose left name is not the greater one.
    """
    l, r = (df.select(*on, "name").where("name <> ''").dropna().distinct() for df in (left, right))
    if threshold >= 1:
        return l.join(r, [*on, "name"]).select(*on, F.col("name").alias("l_name"), F.col("name").alias("r_name"), F.lit(1.0).alias("ratio"))
    common = l.select("name").union(r.select("name")).distinct().select(F.explode(_all_marks("name")).alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mark").limit(RANKED).collect()  # RANKED rows at most
    rank = {x["mark"]: len(common) - k for k, x in enumerate(common)}
    step = math.log((2 - threshold) / threshold * (1 + 1e-9))

    def side(df: DataFrame, x: str, spread: tuple[int, ...]) -> DataFrame:
        level = F.floor(F.log(F.length("name").cast("double")) / step)
        rows = df.withColumn("m", _marked(threshold, rank)).select(*on, F.col("name").alias(f"{x}_name"), F.col("m.every").alias(f"{x}_every"), F.col("m.first").alias(f"{x}_first"), level.alias("level"))
        return rows.withColumn("mark", F.explode(f"{x}_first")).withColumn("level", F.explode(F.array(*[F.col("level") + k for k in spread])))

    both = side(l, "l", (0,)).join(side(r, "r", (-1, 0, 1)), [*on, "mark", "level"])
    if ordered:
        both = both.where("l_name <= r_name")
    both = both.where(F.col("mark") == F.array_min(F.array_intersect("l_first", "r_first")))
    both = both.where(2 * F.size(F.array_intersect("l_every", "r_every")) >= threshold * (F.size("l_every") + F.size("r_every")) - 1e-9)
    return both.select(*on, "l_name", "r_name", sequence_ratio(F.col("l_name"), F.col("r_name")).alias("ratio")).where(F.col("ratio") >= threshold)


def folded(c: Column) -> Column:
    """A value as text without blanks around and case; empty where it is missing."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))


def _slots(df: DataFrame, secondary: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (id, kind, name, one, two, fields): the folded name and values of the type's one or two fields."""
    of = lambda k: functools.reduce(lambda w, x: w.when(F.col("entity_type") == x[0], folded(F.col(x[1][k])) if len(x[1]) > k and x[1][k] in df.columns else F.lit("")), secondary.items(), F.when(F.lit(False), "")).otherwise("")
    fields = functools.reduce(lambda w, x: w.when(F.col("entity_type") == x[0], len(x[1])), secondary.items(), F.when(F.lit(False), 0)).otherwise(0)
    return df.select("id", F.col("entity_type").alias("kind"), folded(F.col("name")).alias("name"), of(0).alias("one"), of(1).alias("two"), fields.alias("fields"))


def best_entity(records: DataFrame, entities: DataFrame, secondary: dict[str, tuple[str, ...]] = SECONDARY, least: float = 0.72) -> DataFrame:
    """(r_id, l_id, score, name_score): for each record the entity of its type with the highest 0.7 name + 0.3 secondary, then least id.

    Rows are id, entity_type, name and the type's fields; secondary is the share of these that both have, equal but for case and blanks around. Records of
    which no entity reaches `least` have no row, and no decision of `resolve` depends on them. No pair that reaches it is lost.
    """
    key = ["kind", "name", "one", "two"]
    rows = _slots(records, secondary)
    left = materialize(rows.groupBy(*key, "fields").agg(F.count("*").alias("n")), "records")
    right = materialize(_slots(entities, secondary).groupBy(*key).agg(F.min("id").alias("l_id")), "entities")
    same = lambda c: (F.col(f"r_{c}") == F.col(f"l_{c}")) & (F.col(f"l_{c}") != "")
    #: (number of fields, those that are equal while all others differ, their share)
    patterns = [(2, ["one", "two"], 1.0), (1, ["one"], 1.0), (2, ["one"], 0.5), (2, ["two"], 0.5), (2, [], 0.0), (1, [], 0.0), (0, [], 0.0)]
    found = []
    for fields, equal, share in patterns:
        ratio = (least - 0.3 * share) / 0.7 - 1e-9
        if ratio > 1:
            continue
        on = ["kind", *equal]
        there = functools.reduce(Column.__and__, [F.col(c) != "" for c in equal], F.lit(True))
        mine, theirs = left.where(there & (F.col("fields") == fields)), right.where(there)
        a = mine.select(*on, F.col("name").alias("l_name"), F.col("one").alias("r_one"), F.col("two").alias("r_two"))
        b = theirs.select(*on, F.col("name").alias("r_name"), F.col("one").alias("l_one"), F.col("two").alias("l_two"), "l_id")
        pairs = similar_names(mine, theirs, on, max(ratio, 1e-9)).join(a, [*on, "l_name"]).join(b, [*on, "r_name"])
        pairs = functools.reduce(lambda df, c: df.where(~same(c)), {"one", "two"} - set(equal), pairs)
        score = 0.7 * F.col("ratio") + 0.3 * share
        found.append(pairs.where(score >= least - 1e-9).select("kind", F.col("l_name").alias("name"), F.col("r_one").alias("one"), F.col("r_two").alias("two"), "l_id", F.col("ratio").alias("name_score"), F.round(score, 6).alias("score")))
    best = functools.reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.max(F.struct("score", (-F.col("l_id")).alias("neg"), "name_score")).alias("b"))
    return rows.join(best, key).select(F.col("id").alias("r_id"), (-F.col("b.neg")).alias("l_id"), F.col("b.score").alias("score"), F.col("b.name_score").alias("name_score"))


def entity_by_name(mentions: DataFrame, entities: DataFrame, least: float = 0.9) -> DataFrame:
    """(r_id, l_id, score): for every mention the entity of its type whose folded name is most like it, from `least` on, then of least id; else nulls."""
    rows = mentions.select(F.col("id").alias("r_id"), F.col("entity_type").alias("kind"), folded(F.col("name")).alias("name"))
    known = entities.select("id", F.col("entity_type").alias("kind"), folded(F.col("name")).alias("name")).groupBy("kind", "name").agg(F.min("id").alias("l_id"))
    names = similar_names(known, rows, ["kind"], least)
    best = names.join(known.withColumnRenamed("name", "l_name"), ["kind", "l_name"]).groupBy("kind", "r_name").agg(F.max(F.struct("ratio", (-F.col("l_id")).alias("neg"))).alias("b"))
    return rows.join(best.withColumnRenamed("r_name", "name"), ["kind", "name"], "left").select("r_id", (-F.col("b.neg")).alias("l_id"), F.round("b.ratio", 6).alias("score"))


def _by_type(table: dict[str, tuple[str, ...]], columns: list[str], what) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for kind, fields in table.items():
        out = out.when(F.col("record_type") == kind, what([f for f in fields if f in columns]))
    return F.coalesce(out, F.array().cast("array<string>"))


def _identified(df: DataFrame) -> DataFrame:
    """Rows (id, source_id, kind, name, had, values): the names of the type's fields that are not null, and name=value of each."""
    value = lambda f: F.lower(F.trim(F.col(f).cast("string")))
    had = _by_type(IDENTITY, df.columns, lambda fs: F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), f) for f in fs]).cast("array<string>")))
    values = _by_type(IDENTITY, df.columns, lambda fs: F.array_compact(F.array(*[F.concat(F.lit(f"{f}="), value(f)) for f in fs]).cast("array<string>")))
    return df.select("id", "source_id", F.col("record_type").alias("kind"), F.coalesce(S.normalize_name(F.col("name")), F.lit("")).alias("name"), had.alias("had"), values.alias("values"))


def identity_pairs(left: DataFrame, right: DataFrame, merge: float, review: float, least_name: float) -> DataFrame:
    """Pairs of a stored and an incoming class that reach `review`: all columns of both sides, score and decision (merge or review)."""
    home = ["source_id", "kind"]
    a, b = (df.select(*home, *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in home]) for df, x in ((left, "l"), (right, "r")))
    alone = similar_names(left, right, home, max(least_name, review / 0.75 - 1e-9))
    exact = alone.join(a, [*home, "l_name"]).join(b, [*home, "r_name"]).where(F.size(F.array_intersect("l_values", "r_values")) == 0)
    with_value = lambda df, c: df.withColumn("value", F.explode(c))
    sharing = similar_names(with_value(left, "values"), with_value(right, "values"), [*home, "value"], least_name)
    shared = sharing.join(with_value(a, "l_values"), [*home, "value", "l_name"]).join(with_value(b, "r_values"), [*home, "value", "r_name"])
    shared = shared.where(F.col("value") == F.array_min(F.array_intersect("l_values", "r_values"))).drop("value")
    equal, compared = F.array_intersect("l_values", "r_values"), F.size(F.array_intersect("l_had", "r_had"))
    of = lambda fields: F.exists(equal, lambda x: F.substring_index(x, "=", 1).isin(*fields))
    strong = functools.reduce(Column.__or__, [(F.col("kind") == k) & of(fields) for k, fields in STRONG.items()])
    score = 0.75 * F.col("ratio") + 0.25 * F.when(compared > 0, F.size(equal) / compared).otherwise(0.0)
    pairs = exact.unionByName(shared).withColumn("score", score).where(F.col("score") >= review - 1e-9)
    return pairs.withColumn("decision", F.when((F.col("score") >= merge - 1e-9) & strong, "merge").otherwise("review")).withColumn("score", F.round("score", 6))


def dedupe_records(stored: DataFrame, incoming: DataFrame, merge: float = 0.85, review: float = 0.7, least_name: float = 0.7) -> DataFrame:
    """A decision for every incoming row against the stored rows of its source and type: id, match_id, score, decision, name.

    Rows are id, source_id, record_type, name, fingerprint and what they have of the type's fields. Of the stored rows whose normalised name has a ratio of least_name the one with
    the highest 0.75 ratio + 0.25 equal over comparable fields counts (then least id): merge from .85 on with an equal strong field, else review from .7 on, else insert. What is not
    merged and has a stored row's very name gets the start of its fingerprint behind its own.
    """
    key = ["source_id", "kind", "name", "had", "values"]
    rows = _identified(incoming)
    left = materialize(_identified(stored).groupBy(*key).agg(F.min("id").alias("match_id")), "stored")
    right = materialize(rows.select(*key).distinct(), "incoming")
    home = ["source_id", "kind"]
    pairs = identity_pairs(left, right, merge, review, least_name)
    best = pairs.groupBy(*home, F.col("r_name").alias("name"), F.col("r_had").alias("had"), F.col("r_values").alias("values")).agg(F.max(F.struct("score", (-F.col("l_match_id")).alias("neg"), "decision")).alias("b"))
    taken = left.select(*home, "name").distinct().withColumn("taken", F.lit(True))
    told = rows.join(best, key, "left").join(taken, [*home, "name"], "left").join(incoming.select("id", "fingerprint"), "id")
    decision = F.coalesce("b.decision", F.lit("insert"))
    clash = F.col("taken").isNotNull() & (F.col("name") != "") & (decision != "merge")
    return told.select("id", (-F.col("b.neg")).alias("match_id"), F.col("b.score").alias("score"), decision.alias("decision"), F.when(clash, F.concat("name", F.lit("--"), F.substring("fingerprint", 1, 12))).otherwise(F.col("name")).alias("name"))


def matched_records(stored: DataFrame, incoming: DataFrame, merge: float = 0.85, review: float = 0.7, least_name: float = 0.7) -> DataFrame:
    """(l_id, r_id, score, decision): the pairs of a stored and an incoming class of equal rows that want review or merging, each class by its least id."""
    key = ["source_id", "kind", "name", "had", "values"]
    left, right = (materialize(_identified(df).groupBy(*key).agg(F.min("id").alias("first")), "identities") for df in (stored, incoming))
    return identity_pairs(left, right, merge, review, least_name).select(F.col("l_first").alias("l_id"), F.col("r_first").alias("r_id"), "score", "decision")


def block_of(name: Column, length: int = 3) -> Column:
    """The first letters and digits, of any script, of a lower-cased name; empty if it has none."""
    return F.substring(F.regexp_replace(folded(name), r"[^\p{L}\p{N}]", ""), 1, length)


def candidate_pairs(entities: DataFrame, length: int = 3) -> DataFrame:
    """(l_id, r_id, role): pairs of distinct folded names of one type that begin alike, each name by its least id ("pair"); and the entities of each name beside its least ("member").

    Names without letters and digits are one block of their type, as are empty ones.
    """
    rows = entities.select("id", "entity_type", folded(F.col("name")).alias("name"))
    names = rows.groupBy("entity_type", "name").agg(F.min("id").alias("first")).withColumn("block", block_of(F.col("name"), length))
    a, b = (names.select("entity_type", "block", F.col("first").alias(x)) for x in ("l_id", "r_id"))
    pairs = a.join(b, ["entity_type", "block"]).where("l_id < r_id").select("l_id", "r_id", F.lit("pair").alias("role"))
    return pairs.unionByName(rows.join(names, ["entity_type", "name"]).where("id <> first").select(F.col("first").alias("l_id"), F.col("id").alias("r_id"), F.lit("member").alias("role")))


def _compared(df: DataFrame, fields: tuple[str, ...], length: int) -> DataFrame:
    """Classes (kind, block, name, had, values) with their least id; values that are missing or empty are not compared."""
    fields = tuple(f for f in fields if f in df.columns)
    there = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    had = F.array_compact(F.array(*[F.when(there(f), f) for f in fields]).cast("array<string>"))
    values = F.array_compact(F.array(*[F.when(there(f), F.concat(F.lit(f"{f}="), folded(F.col(f)))) for f in fields]).cast("array<string>"))
    return df.select("id", F.col("entity_type").alias("kind"), block_of(F.col("name"), length).alias("block"), F.when(folded(F.col("name")) == "", "\0").otherwise(folded(F.col("name"))).alias("name"), had.alias("had"), values.alias("values"))


def entity_links(entities: DataFrame, least: float = 0.94, fields: tuple[str, ...] = OVERLAP, length: int = 3) -> DataFrame:
    """(l_id, r_id, score), l_id < r_id: pairs of one type and name beginning whose 0.8 name + 0.2 equal over comparable fields, or the name alone if none is comparable, reaches `least` (over 0.8).

    Entities of equal folded name and fields are one class: each links to its least id, which stands for it in all other pairs. Of classes that have no comparable field
    all those of two such sets of fields link alike, so each links to the least of the other set. The ratio goes from the least to the greater name.
    """
    key = ["kind", "block", "name", "had", "values"]
    rows = _compared(entities, fields, length)
    classes = materialize(rows.groupBy(*key).agg(F.min("id").alias("first")), "classes")
    home = ["kind", "block"]
    side = lambda df, x: df.select(*home, *[F.col(c).alias(f"{x}_{c}") for c in ("name", "had", "values", "first")])

    value = classes.where("size(values) > 0").withColumn("value", F.explode("values"))
    like = similar_names(value, value, [*home, "value"], (least - 0.2) / 0.8 - 1e-9, ordered=True)
    a, b = (side(classes, x).withColumn("value", F.explode(f"{x}_values")) for x in ("l", "r"))
    near = like.join(a, [*home, "value", "l_name"]).join(b, [*home, "value", "r_name"]).where((F.col("l_name") != F.col("r_name")) | (F.col("l_first") < F.col("r_first")))
    near = near.where(F.col("value") == F.array_min(F.array_intersect("l_values", "r_values")))
    shared = F.size(F.array_intersect("l_values", "r_values")) / F.size(F.array_intersect("l_had", "r_had"))
    scored = near.select("l_first", "r_first", F.round(0.8 * F.col("ratio") + 0.2 * shared, 6).alias("score"))

    sets = classes.groupBy(*home, "name", "had").agg(F.min("first").alias("first"))
    names = similar_names(sets, sets, home, least - 1e-9, ordered=True)
    a, b = (sets.select(*home, *[F.col(c).alias(f"{x}_{c}") for c in ("name", "had", "first")]) for x in ("l", "r"))
    apart = names.join(a, [*home, "l_name"]).join(b, [*home, "r_name"]).where((F.size(F.array_intersect("l_had", "r_had")) == 0) & ((F.col("l_name") != F.col("r_name")) | (F.col("l_first") < F.col("r_first"))))
    star = lambda x, y: apart.select(*home, F.col(f"{x}_name").alias("name"), F.col(f"{x}_had").alias("had"), F.col(f"{y}_first").alias("r_first"), "ratio").join(classes, [*home, "name", "had"]).select(F.col("first").alias("l_first"), "r_first", F.round("ratio", 6).alias("score"))
    every = scored.unionByName(star("l", "r")).unionByName(star("r", "l")).where((F.col("score") >= least) & (F.col("l_first") != F.col("r_first")))
    members = rows.join(classes, key).where("id <> first").select(F.col("first").alias("l_first"), F.col("id").alias("r_first"), F.lit(1.0).alias("score"))
    every = every.unionByName(members)
    return every.groupBy(F.least("l_first", "r_first").alias("l_id"), F.greatest("l_first", "r_first").alias("r_id")).agg(F.max("score").alias("score"))


def _kinds(s, d):
    """The entities of the test tables with the six types, and brand and size as the fields of each."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in zip(("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"), ("artist", "artwork", "exhibition", "event", "venue", "organization"), strict=True) for x in p]), F.substring_index("entity_type", " ", 1))
    e = view(s, d, "entities_v").withColumn("entity_type", kind).withColumn("record_type", kind).withColumn("source_id", F.col("year") % 5)
    e = e.withColumn("fingerprint", F.sha2(F.concat_ws("|", "id", "name"), 256)).withColumn("size", F.col("year").cast("string"))
    return e.withColumns({f: F.col("city") for f in ("nationality", "medium", "venue_name", "address")} | {f: F.col("size") for f in ("birth_year", "start_date")})


def _sides(s, d):
    """Entities with odd ids as incoming records, those with even ids as stored."""
    e = _kinds(s, d)
    return e.where("id % 2 = 1"), e.where("id % 2 = 0")


def _resolved(s, d):
    records, entities = _sides(s, d)
    linked = view(s, d, "links_v").where("entity_id % 10 = 1").groupBy(F.col("entity_id").alias("r_id")).agg(F.min("source_id").alias("entity_id"))
    return resolve(records.withColumn("confidence", F.col("confidence") / 20), best_entity(records, entities), linked)


def _fields(s, d):
    return view(s, d, "entities_v").select("id", "entity_type", "name", "city", "year", "confidence")


QUERIES = {
    "candidate_pairs": lambda s, d: candidate_pairs(view(s, d, "entities_v")),
    "identity_match": lambda s, d: matched_records(*reversed(_sides(s, d))),
    "record_dedupe": lambda s, d: dedupe_records(*reversed(_sides(s, d))),
    "entity_pair_score": lambda s, d: entity_links(_fields(s, d)),
    "best_entity_match": lambda s, d: best_entity(*_sides(s, d)),
    "merge_clusters": lambda s, d: winners(clusters(entity_links(_fields(s, d)).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))), _fields(s, d)),
    "resolve_records": _resolved,
    "entity_by_name": lambda s, d: entity_by_name(*_sides(s, d)),
}

_NAMES = "k as (select id, entity_type, lower(trim(name)) as name, substr(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}]', '', 'g'), 1, 3) as b from entities_v), c as (select entity_type, name, b, min(id) as first from k group by all)"
ORACLE = {
    "candidate_pairs": with_views(f"with {_NAMES} select x.first as l_id, y.first as r_id, 'pair' as role from c x join c y on x.entity_type = y.entity_type and x.b = y.b and x.first < y.first union all select first, id, 'member' from k join c using (entity_type, name) where id <> first"),
}
