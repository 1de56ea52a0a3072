"""Drift of families and fields, signals, and selector repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions import scores as S
from loomscan.operators.mapping import TIE, first_few
from loomscan.operators.ranking import latest
from loomscan.operators.reports import proposals_of, repair_feedback
from loomscan.sources.views import view, with_views

#: Signal, medium and high threshold of a family's ratios.
THRESHOLDS = [("null_rate_spike", "miss", 0.35, 0.55), ("refresh_change_spike", "change", 0.45, 0.70), ("unexpected_skip_spike", "skip", 0.20, 0.35)]

#: States of a signal, weights of a severity, fields that weigh in full.
STATUSES = ("open", "acknowledged", "resolved", "dismissed")
SEVERITY_WEIGHTS = {"high": 1.0, "medium": 0.7, "low": 0.4}
MAIN_FIELDS = ("title", "name", "start_date", "venue_name")


def family_ratios(rows: DataFrame, by: list[str], least: int = 8) -> DataFrame:
    """Miss, change and unexpected-skip ratios of families of at least so many rows."""
    skipped = F.col("status") == "skipped"
    reason = F.coalesce("skip_reason", F.lit(""))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("size"), F.count_if(reason == "selector_miss").alias("misses"), F.count_if(F.coalesce(F.col("last_refresh_outcome") == "changed", F.lit(False))).alias("changes"),
        F.count_if(F.col("last_refresh_outcome").isNotNull()).alias("refreshed"), F.count_if(skipped & ~reason.isin("robots", "selector_miss")).alias("odd_skips"),
    ).where(F.col("size") >= least)
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return g.select(*by, "size", share("misses", "size").alias("miss"), share("changes", "refreshed").alias("change"), share("odd_skips", "size").alias("skip"))


def family_drift(ratios: DataFrame, by: list[str]) -> DataFrame:
    """A row for each ratio at or above its medium threshold."""
    found = F.array(*[F.struct(F.lit(n).alias("signal"), F.round(c, 6).alias("ratio"), F.when(F.col(c) >= hi, "high").when(F.col(c) >= mid, "medium").alias("severity")) for n, c, mid, hi in THRESHOLDS])
    return ratios.select(*by, F.explode(found).alias("x")).select(*by, "x.*").where("severity is not null")


def value_anomaly(kind: Column, old: Column, new: Column, mean: Column, sd: Column) -> Column:
    """(severity, confidence) of a value (as text) that left its pattern; null where it did not or a side is null.

    number: further from the mean (the old value without one) than 2.5 deviations and than 1; date: another month;
    text: its length changed by half or more, or digits appeared or vanished.
    """
    found = lambda severity, confidence: F.struct(F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    away = F.abs(new.try_cast("double") - F.coalesce(mean, old.try_cast("double")))
    before, after = F.greatest(F.length(F.trim(old)), F.lit(1)), F.length(F.trim(new))
    change = F.abs(after - before) / before
    number = F.when(away > F.greatest(2.5 * F.coalesce(sd, F.lit(0.0)), F.lit(1.0)), found("medium", 0.8))
    date = F.when(F.substring(old, 1, 7) != F.substring(new, 1, 7), found("low", 0.6))
    text = F.when(change >= 1, found("medium", 0.7)).when(change >= 0.5, found("low", 0.7)).when(old.rlike("[0-9]") != new.rlike("[0-9]"), found("low", 0.65))
    return F.when(old.isNotNull() & new.isNotNull(), F.when(kind == "number", number).when(kind == "date", date).otherwise(text))


def field_drift(values: DataFrame) -> DataFrame:
    """Signals of fields (id, field, kind, previous, current, mean, sd): missing, empty, or an anomaly of the value."""
    had = F.coalesce(F.trim("previous") != "", F.lit(False))
    signal = lambda name, severity, confidence: F.struct(F.lit(name).alias("signal"), severity.alias("severity"), confidence.alias("confidence"))
    odd = value_anomaly(F.col("kind"), F.col("previous"), F.col("current"), F.col("mean"), F.col("sd"))
    lost = F.when(had & F.col("current").isNull(), signal("field_missing", F.lit("high"), F.lit(0.95))).when(had & (F.trim("current") == ""), signal("field_empty", F.lit("high"), F.lit(0.95)))
    x = F.coalesce(lost, F.when(odd.isNotNull(), signal("value_anomaly", odd["severity"], odd["confidence"])))
    return values.select("id", "field", x.alias("x")).where("x is not null").select("id", "field", "x.*")


def page_drift(pages: DataFrame, drop: int = 25) -> DataFrame:
    """Signals of whole pages: a selector named in the error, another structure, a confidence that fell by so much."""
    signal = lambda on, name, severity, confidence: F.when(on, F.struct(F.lit(name).alias("signal"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    changed = (F.col("old_hash") != "") & (F.col("new_hash") != "") & (F.col("old_hash") != F.col("new_hash"))
    fell = F.col("old_confidence") - F.coalesce("new_confidence", F.lit(0)) >= drop
    found = F.array_compact(F.array(signal(F.contains(F.lower("error"), F.lit("selector")), "selector_fail", "high", 0.92), signal(changed, "structure_changed", "medium", 0.85), signal(fell, "confidence_drop", "medium", 0.8)))
    return pages.select("id", F.lit(None).cast("string").alias("field"), F.explode(found).alias("x")).select("id", "field", "x.*")


def apply_status(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Signals after their status events (signal_id, status, at, id, note): the latest status, when it was last acknowledged and closed, the latest note.

    Events with another status are refused; a signal without events keeps its row.
    """
    order = F.struct("at", "event")
    e = events.where(F.col("status").isin(*STATUSES)).select(F.col("signal_id").alias("id"), F.col("status").alias("now"), "at", F.col("id").alias("event"), "note").groupBy("id").agg(
        F.max_by("now", order).alias("now"), F.max(F.when(F.col("now") == "acknowledged", F.col("at"))).alias("acknowledged_at"), F.max(F.when(F.col("now").isin("resolved", "dismissed"), F.col("at"))).alias("resolved_at"),
        F.max_by("note", F.when(F.col("note").isNotNull(), order)).alias("note"),
    )
    return signals.join(e, "id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def coalesce_signals(signals: DataFrame, by: list[str], hours: int = 12) -> DataFrame:
    """Live signals of a key become one as long as each comes within the gap after the last; latest values kept."""
    w = Window.partitionBy(*by).orderBy("detected_at", "id")
    new = F.when(F.col("detected_at") <= F.lag("detected_at").over(w) + F.expr(f"interval '{hours}' hour"), 0).otherwise(1)
    live = signals.where(F.col("status").isin("open", "acknowledged")).withColumn("new", new)
    run = live.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("detected_at", "id", "severity"))
    return run.groupBy(*by, "run").agg(F.count("*").alias("occurrences"), F.min("detected_at").alias("first_at"), last["detected_at"].alias("last_at"), last["severity"].alias("severity")).drop("run")


def repair_score(c: DataFrame) -> DataFrame:
    """Columns heuristic, success, plausible, accepted, applied, nonsense to a confidence within 0..1."""
    raw = 0.45 * F.col("heuristic") + 0.25 * F.col("success") + 0.15 * F.col("plausible") + 0.10 * F.col("accepted") + 0.05 * F.col("applied") - 0.2 * F.col("nonsense")
    return c.withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)) + TIE, 4))


def repair_priority(severity: Column, pages: Column, field: Column) -> Column:
    """Severity times pages (1 at least) times the field's weight; an unknown severity weighs 0.5."""
    weight = F.lit(0.5)
    for name, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.lower(severity) == name, w).otherwise(weight)
    return F.round(weight * F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) * F.when(F.lower(field).isin(*MAIN_FIELDS), 1.0).otherwise(0.7) + TIE, 4)


def validate(values: DataFrame, by: list[str], field: str) -> DataFrame:
    """Rates of a candidate's values (value, null where the selector found nothing) for a field.

    success: there; plausible: of all; diversity and consistency: distinct values, and what the most frequent one leaves,
    of those there; pattern and nonsense: of those there, 0 and 1 without any. Validated at .8, .8, .2 and .4.
    """
    f, text = F.lit(field), F.nullif(F.trim("value"), F.lit(""))
    per = values.groupBy(*by, text.alias("value")).agg(F.count("*").alias("n")).withColumn("key", F.lower("value"))
    there = F.col("value").isNotNull()
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    folded = per.groupBy(*by, "key").agg(F.sum("n").alias("n"), many(there).alias("hits"), many(S.field_plausible(f, F.col("value"))).alias("plausible"), many(there & S.pattern_valid(f, F.col("value"))).alias("valid"), many(there & S.nonsensical(f, F.col("value"))).alias("odd"))
    g = folded.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "hits", "plausible", "valid", "odd")], F.count("key").alias("distinct"), F.max(F.when(F.col("key").isNotNull(), F.col("n"))).alias("top"))
    share = lambda a, b, none=0.0: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(none)), 4)
    rates = g.select(*by, share("hits", "n").alias("success"), share("plausible", "n").alias("plausible"), share("distinct", "hits").alias("diversity"), F.round(1 - F.coalesce(F.col("top") / F.nullif(F.col("hits"), F.lit(0)), F.lit(1.0)), 4).alias("consistency"), share("valid", "hits").alias("pattern"), share("odd", "hits", 1.0).alias("nonsense"))
    return rates.withColumn("validated", (F.col("success") >= 0.8) & (F.col("plausible") >= 0.8) & (F.col("diversity") >= 0.2) & (F.col("consistency") >= 0.4))


def proposal_upsert(found: DataFrame, pages: int = 5) -> DataFrame:
    """One row per (source_id, edge_type): highest confidence, occurrences, the first page ids."""
    by = ["source_id", "edge_type"]
    g = found.groupBy(*by).agg(F.round(F.max("confidence"), 4).alias("confidence"), F.count("*").alias("occurrences"))
    few = first_few(found.select(*by, "id").distinct().withColumn("url", F.lit("")), by, pages)
    return g.join(few, by).select(*by, "confidence", "occurrences", F.array_join(F.transform("s", lambda x: x["id"]), ",").alias("pages"))


CUT = "timestamp '1995-06-17 00:00:00'"


def _lines(s, d):
    return view(s, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_extendedprice", "l_quantity", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))


def _baseline(s, d):
    return _lines(s, d).where(f"l_shipdate < {CUT}").groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.stddev_samp("l_quantity"), 4).alias("sd"))


def _latest(s, d):
    return latest(_lines(s, d).where(f"l_shipdate >= {CUT}").select("id", "l_shipdate", "line", "l_quantity"), ["id"], "l_shipdate", "line")


def _values(s, d):
    """What candidates found: nothing, a word that says nothing, one letter, or a name."""
    text = F.when(F.col("line") == 3, "Unknown").when(F.col("line") == 5, F.col("edge_type")).otherwise(F.concat("edge_type", F.lit("-"), F.col("to_id").cast("string")))
    return view(s, d, "edges_v").select("from_id", F.when(F.col("confidence") < 0.99, text).alias("value"))


def _pairs(s, d):
    """Titles that are kept, lost, emptied, doubled or numbered; order dates that move; quantities against their baseline."""
    r = view(s, d, "records_v")
    title = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 == 1, " ").when(F.col("id") % 7 == 2, F.concat("title", "title")).when(F.col("id") % 7 == 3, F.concat(F.lit("7 "), "title")).otherwise(F.col("title"))
    none = [F.lit(None).cast("double").alias(c) for c in ("mean", "sd")]
    titles = r.select("id", F.lit("title").alias("field"), F.lit("text").alias("kind"), F.col("title").alias("previous"), title.alias("current"), *none)
    day = F.to_date("created_at")
    dates = view(s, d, "jobs_v").select("id", F.lit("start_date").alias("field"), F.lit("date").alias("kind"), day.cast("string").alias("previous"), F.date_add(day, (F.col("id") % 20).cast("int")).cast("string").alias("current"), *none)
    numbers = _latest(s, d).join(_baseline(s, d), "id").select("id", F.lit("quantity").alias("field"), F.lit("number").alias("kind"), F.col("mean").cast("string").alias("previous"), F.col("l_quantity").cast("string").alias("current"), F.col("mean").cast("double").alias("mean"), F.col("sd").cast("double").alias("sd"))
    return titles.union(dates).union(numbers)


def _drifted_pages(s, d):
    p = view(s, d, "pages_v").select("id", F.when(F.col("status") == "error", F.concat(F.lit("Selector missed for "), "path")).alias("error"), F.md5("path").alias("old_hash"), F.md5(F.when(F.col("id") % 3 == 0, F.concat("path", F.lit("/"))).otherwise(F.col("path"))).alias("new_hash"), ((F.col("id") * 7) % 101).alias("old_confidence"), (F.col("id") % 90).alias("new_confidence"))
    return page_drift(p)


def _status_events(s, d):
    """Two events for each signal of the first half; every fifth has a note, some statuses are none."""
    status = F.element_at(F.array(*map(F.lit, (*STATUSES, "reopened"))), (F.col("id") % 5 + 1).cast("int"))
    return view(s, d, "log_v").select(F.col("id"), F.floor(F.col("id") / 2).alias("signal_id"), status.alias("status"), F.col("ts").alias("at"), F.when(F.col("id") % 5 < 3, F.col("message")).alias("note"))


def _repairs(s, d):
    v = validate(_values(s, d), ["from_id"], "title").withColumn("source_id", F.col("from_id") % 60).withColumn("field", F.concat(F.lit("f"), (F.col("from_id") % 9).cast("string")))
    known = v.join(repair_feedback(proposals_of(view(s, d, "signals_v"))), ["source_id", "field"], "left")
    c = known.select("from_id", F.lit(0.7).alias("heuristic"), "success", "plausible", F.coalesce("accepted_rate", F.lit(0.5)).alias("accepted"), F.coalesce("apply_success_rate", F.lit(0.5)).alias("applied"), "nonsense")
    severity = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (F.col("from_id") % 4 + 1).cast("int"))
    field = F.when(F.col("from_id") % 3 == 0, "Title").otherwise("year")
    return repair_score(c).select("from_id", "confidence", repair_priority(severity, F.col("from_id") % 7, field).alias("priority"))


FAMILY = ["source_id"]
QUERIES = {
    "family_drift": lambda s, d: family_drift(family_ratios(view(s, d, "frontier_v"), FAMILY, 3), FAMILY),
    "new_family": lambda s, d: view(s, d, "pages_v").groupBy("source_id").agg(F.count("*").alias("n")).where("n >= 5").join(view(s, d, "pages_v").where("id % 9 = 0").select("source_id"), "source_id", "left_anti"),
    "field_drift": lambda s, d: field_drift(_pairs(s, d)).union(_drifted_pages(s, d)),
    "value_anomaly": lambda s, d: _pairs(s, d).select("id", "field", value_anomaly(F.col("kind"), F.col("previous"), F.col("current"), F.col("mean"), F.col("sd")).alias("x")).select("id", "field", "x.severity", "x.confidence"),
    "baseline_stats": _baseline,
    "drift_summary": lambda s, d: view(s, d, "signals_v").groupBy("source_id").agg(F.count("*").alias("signals"), F.count_if(F.col("severity") == "high").alias("high"), F.round(F.count_if(F.col("severity") == "high") / F.count("*"), 4).alias("rate")).withColumn("alert", F.col("rate") > 0.2),
    "signal_coalesce": lambda s, d: coalesce_signals(view(s, d, "signals_v"), ["source_id", "signal_type"]),
    "signal_status": lambda s, d: apply_status(view(s, d, "signals_v"), _status_events(s, d)).select("id", "status", "acknowledged_at", "resolved_at", "note"),
    "selector_validate": lambda s, d: validate(_values(s, d), ["from_id"], "title"),
    "repair_score": _repairs,
    "proposal_upsert": lambda s, d: proposal_upsert(view(s, d, "edges_v").select(F.col("to_id").alias("source_id"), "edge_type", "confidence", F.col("from_id").alias("id"))),
    "repair_guard": lambda s, d: validate(_values(s, d).where("from_id % 2 = 0"), ["from_id"], "title").select((F.col("from_id") + 1).alias("from_id"), F.col("success").alias("before")).join(validate(_values(s, d), ["from_id"], "title").select("from_id", F.col("success").alias("after")), "from_id").withColumn("apply", F.col("after") >= F.col("before") - 0.05),
}

_VALID = """x as (select from_id, case when confidence < 0.99 then case line when 3 then 'Unknown' when 5 then edge_type else edge_type || '-' || to_id end end as value from edges_v),
    c as (select from_id, lower(value) as k, count(*) as n from x where value is not null group by 1, 2), d as (select from_id, count(*) as d, max(n) as top from c group by 1),
    h as (select from_id, count(*) as n, count(value) as hits, count_if(lower(value) <> 'unknown' and length(value) >= 2) as ok, count_if(length(value) > 1) as pat, count_if(lower(value) = 'unknown' or length(value) <= 1) as odd from x group by 1),
    v as (select h.from_id, round(hits / n, 4) as success, round(ok / n, 4) as plausible, round(coalesce(d.d / nullif(hits, 0), 0), 4) as diversity, round(1 - coalesce(top / nullif(hits, 0), 1), 4) as consistency, round(coalesce(pat / nullif(hits, 0), 0), 4) as pattern, round(coalesce(odd / nullif(hits, 0), 1), 4) as nonsense from h left join d on d.from_id = h.from_id)"""
_RATIO = "g as (select source_id, count(*) as size, count_if(coalesce(skip_reason, '') = 'selector_miss') / count(*) as miss, coalesce(count_if(coalesce(last_refresh_outcome = 'changed', false)) / nullif(count(last_refresh_outcome), 0), 0) as change, count_if(status = 'skipped' and coalesce(skip_reason, '') not in ('robots', 'selector_miss')) / count(*) as skip from frontier_v group by 1 having count(*) >= 3)"
_BASE = f"b as (select l_partkey as id, count(*) as n, round(avg(l_quantity), 4) as mean, round(stddev_samp(l_quantity), 4) as sd from lineitem where l_shipdate < {CUT} group by 1)"
_PAIRS = f"""{_BASE}, l as (select l_partkey as id, arg_max(l_quantity, (l_shipdate, l_orderkey * 10 + l_linenumber)) as q from lineitem where l_shipdate >= {CUT} group by 1),
    p as (select id, 'title' as field, 'text' as kind, title as a, case id % 7 when 0 then null when 1 then ' ' when 2 then title || title when 3 then '7 ' || title else title end as b, null::double as mean, null::double as sd, null::double as x from records_v
    union all select id, 'start_date', 'date', cast(cast(created_at as date) as varchar), cast(cast(created_at as date) + cast(id % 20 as int) as varchar), null, null, null from jobs_v
    union all select l.id, 'quantity', 'number', cast(mean as varchar), cast(q as varchar), mean, sd, q from l join b on b.id = l.id),
    z as (select *, greatest(length(trim(a)), 1) as la, length(trim(b)) as lb from p),
    o as (select *, case when a is null or b is null then null when kind = 'number' then case when abs(x - mean) > greatest(2.5 * coalesce(sd, 0), 1) then 'medium,0.8' end
      when kind = 'date' then case when a[1:7] <> b[1:7] then 'low,0.6' end when abs(lb - la) >= la then 'medium,0.7' when abs(lb - la) * 2 >= la then 'low,0.7' when regexp_matches(a, '[0-9]') <> regexp_matches(b, '[0-9]') then 'low,0.65' end as odd from z)"""
ORACLE = {k: with_views(v) for k, v in {
    "family_drift": f"with {_RATIO} " + " union all ".join(f"select source_id, '{n}' as signal, round({c}, 6)::double as ratio, case when {c} >= {hi} then 'high' else 'medium' end as severity from g where {c} >= {mid}" for n, c, mid, hi in THRESHOLDS),
    "new_family": "select source_id, count(*) as n from pages_v where source_id not in (select source_id from pages_v where id % 9 = 0) group by 1 having count(*) >= 5",
    "field_drift": f"with {_PAIRS}, f as (select id, field, case when trim(a) <> '' and b is null then 'field_missing,high,0.95' when trim(a) <> '' and trim(b) = '' then 'field_empty,high,0.95' else 'value_anomaly,' || odd end as x from o union all select id, null, 'selector_fail,high,0.92' from pages_v where status = 'error' union all select id, null, 'structure_changed,medium,0.85' from pages_v where id % 3 = 0 and path <> path || '/' union all select id, null, 'confidence_drop,medium,0.8' from pages_v where (id * 7) % 101 - id % 90 >= 25) select id, field, split_part(x, ',', 1) as signal, split_part(x, ',', 2) as severity, split_part(x, ',', 3)::double as confidence from f where x is not null",
    "value_anomaly": f"with {_PAIRS} select id, field, nullif(split_part(odd, ',', 1), '') as severity, nullif(split_part(odd, ',', 2), '')::double as confidence from o",
    "baseline_stats": f"with {_BASE} select * from b",
    "drift_summary": "with c as (select source_id, count(*) as signals, count_if(severity = 'high') as high, round(count_if(severity = 'high') / count(*), 4) as rate from signals_v group by 1) select *, rate > 0.2 as alert from c",
    "signal_coalesce": "with l as (select *, case when detected_at - lag(detected_at) over w <= interval '12' hour then 0 else 1 end as new from signals_v where status in ('open', 'acknowledged') window w as (partition by source_id, signal_type order by detected_at, id)), r as (select *, sum(new) over (partition by source_id, signal_type order by detected_at, id) as run from l) select source_id, signal_type, count(*) as occurrences, min(detected_at) as first_at, max(detected_at) as last_at, arg_max(severity, (detected_at, id)) as severity from r group by source_id, signal_type, run",
    "signal_status": "with e as (select id, id // 2 as signal_id, ['open', 'acknowledged', 'resolved', 'dismissed', 'reopened'][id % 5 + 1] as status, ts, case when id % 5 < 3 then message end as note from log_v), g as (select signal_id, arg_max(status, (ts, id)) as now, max(ts) filter (status = 'acknowledged') as acknowledged_at, max(ts) filter (status in ('resolved', 'dismissed')) as resolved_at, arg_max(note, (ts, id)) filter (note is not null) as note from e where status <> 'reopened' group by 1) select s.id, coalesce(now, status) as status, acknowledged_at, resolved_at, note from signals_v s left join g on g.signal_id = s.id",
    "selector_validate": f"with {_VALID} select *, success >= 0.8 and plausible >= 0.8 and diversity >= 0.2 and consistency >= 0.4 as validated from v",
    "repair_score": f"with {_VALID}, f as (select source_id, field, round(count_if(status <> 'open') / count(*), 4) as ar, round(coalesce(count_if(status = 'resolved' and severity = 'low') / nullif(count_if(status = 'resolved'), 0), 0.5), 4) as sr from signals_v group by 1, 2) select from_id, round(least(1.0, greatest(0.0, 0.45::double * 0.7::double + 0.25 * success + 0.15 * plausible + 0.1::double * coalesce(ar, 0.5) + 0.05::double * coalesce(sr, 0.5) - 0.2 * nonsense)) + 1e-9, 4)::double as confidence, round(case from_id % 4 when 0 then 1.0 when 1 then 0.7 when 2 then 0.4 else 0.5 end::double * greatest(from_id % 7, 1) * case when from_id % 3 = 0 then 1.0 else 0.7 end::double + 1e-9, 4) as priority from v left join f on f.source_id = from_id % 60 and f.field = 'f' || from_id % 9",
    "proposal_upsert": "with p as (select to_id as source_id, edge_type, round(max(confidence), 4) as confidence, count(*) as occurrences, list_sort(list(distinct from_id)) as l from edges_v group by 1, 2) select source_id, edge_type, confidence, occurrences, array_to_string(l[1:5], ',') as pages from p",
    "repair_guard": f"with {_VALID} select a.from_id + 1 as from_id, a.success as before, b.success as after, b.success >= a.success - 0.05 as apply from v a join v b on b.from_id = a.from_id + 1 where a.from_id % 2 = 0",
}.items()}
