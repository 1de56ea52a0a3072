"""Structured Streaming operators, and how their queries run a stream over the event files to its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from loomscan.plans.shared import new_path
from loomscan.sources.tables import normalize_logs, raw_events
from loomscan.sources.views import view, with_views
from loomscan.streaming import moves
from loomscan.streaming.moves import MOVES

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Event types stand for states in the queries.
STATES = {"view": "queued", "click": "fetching", "purchase": "fetched", "error": "failed", "signup": "skipped"}


def read_events(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The event files of a folder as a stream, so many a micro-batch; ts as an instant."""
    raw = (spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)).schema(EVENTS).option("pathGlobFilter", "events*").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def versioned(out: str):
    """A sink of micro-batches: each is written under its number, so that one that runs again replaces itself and no other."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")

    return write


def newest(spark: SparkSession, out: str, schema: StructType, keys: list[str] | None) -> DataFrame:
    """What a versioned sink holds: of each key the row of the last micro-batch that had it; without keys all rows of the last one."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())])).parquet(out)
    if keys is None:
        return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version", "left_semi").drop("version")  # one row
    rest = [c for c in schema.fieldNames() if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*schema.fieldNames())


def run_to_end(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream until its input is used up and reads back what it gave: appended rows; by keys the last row of updates; or the last complete result."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", f"{out}-state")
    query = writer.format("parquet").start(out) if mode == "append" else writer.foreachBatch(versioned(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else newest(spark, out, stream.schema, keys)


def event_filter(events: DataFrame, event_type: str | None = None, source: int | None = None) -> DataFrame:
    out = events if event_type is None else events.where(F.col("event_type") == event_type)
    return out if source is None else out.where(F.col("user_id") == source)


def progress(events: DataFrame) -> DataFrame:
    """Latest stage and value of each key."""
    best = F.max(F.struct("ts", "event_id", "event_type", "value"))
    return events.groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_id").alias("event_id"), F.col("b.event_type").alias("stage"), F.col("b.value").alias("value"))


def usage(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("mean", 4).alias("mean"))


def signal_sessions(signals: DataFrame, gap: str = "12 hours") -> DataFrame:
    g = signals.groupBy("user_id", "event_type", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("occurrences"), F.max("ts").alias("last_at"))
    return g.select("user_id", "event_type", F.col("w.start").alias("first_at"), "last_at", "occurrences")


def running_baseline(events: DataFrame) -> DataFrame:
    """Count, mean and deviation of each key as kept state; a row for each key in each batch."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for part in parts:
            for x in part["value"].dropna().sort_values():
                n += 1
                step = x - mean
                mean += step / n
                m2 += step * (x - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [round(mean, 3)], "sd": [round((m2 / (n - 1)) ** 0.5, 3) if n > 1 else None]})

    return events.groupBy("user_id").applyInPandasWithState(work, "user_id long, n long, mean double, sd double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)


def stale_keys(events: DataFrame, minutes: int = 2) -> DataFrame:
    """A row when a key was silent for so many minutes of event time."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_ms": [last]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(p["ms"].max()) for p in parts)])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("ts", "1 minute").select("user_id", F.unix_millis("ts").alias("ms"), "ts")
    return timed.groupBy("user_id").applyInPandasWithState(work, "user_id long, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(events: DataFrame, within: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def _as_states(events: DataFrame) -> DataFrame:
    out = F.when(F.lit(False), "")
    for k, v in STATES.items():
        out = out.when(F.col("event_type") == k, v)
    return events.select(F.col("user_id").alias("key"), "ts", "event_id", out.alias("state"))


def _folded(ends: DataFrame) -> DataFrame:
    return ends.withColumnRenamed("key", "user_id")


def _instant(df, *names):
    """Instants as local times of the session's zone, as the tables have them."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


QUERIES = {
    "job_event_filter": lambda s, d: run_to_end(event_filter(read_events(s, d), event_type="error").select("event_id", "user_id", "value"), "filtered"),
    "job_progress": lambda s, d: run_to_end(progress(read_events(s, d)), "progress", "complete"),
    "normalize_log_stream": lambda s, d: run_to_end(_instant(normalize_logs(raw_events(read_events(s, d)), "miner", F.expr("timestamp '2024-03-01 00:00:00'"), "warning").withColumnRenamed("timestamp", "ts"), "ts").select("event_id", "ts", "level", "service", "source_id", "message", "context"), "logs"),
    "baseline_stream": lambda s, d: run_to_end(running_baseline(read_events(s, d)), "baseline", "update", ["user_id"]),
    "signal_coalesce_stream": lambda s, d: _instant(run_to_end(signal_sessions(read_events(s, d)), "sessions", "complete"), "first_at", "last_at"),
    "frontier_state": lambda s, d: _folded(moves.fold(_as_states(view(s, d, "events")))[0]),
    "frontier_state_stream": lambda s, d: _folded(run_to_end(moves.fold_stream(_as_states(read_events(s, d))), "moves", "update", ["key"])),
    "frontier_moves": lambda s, d: _folded(moves.fold(_as_states(view(s, d, "events")))[1].where("not valid")).select("user_id", "event_id", "before", "event"),
    "stale_worker_stream": lambda s, d: run_to_end(stale_keys(read_events(s, d)), "stale"),
    "url_first_seen_stream": lambda s, d: run_to_end(first_seen(read_events(s, d)), "seen"),
    "usage_stream": lambda s, d: _instant(run_to_end(usage(read_events(s, d)), "usage", "complete"), "hour"),
}

_OK = " or ".join(f"(split_part(a, '|', 1) = '{k}' and split_part(e, '|', 1) in ({', '.join(repr(x) for x in to)}))" for k, to in MOVES.items())
_STATE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATES.items()) + " end"
ORACLE = {k: with_views(v) for k, v in {
    "job_event_filter": "select event_id, user_id, value from events where event_type = 'error'",
    "job_progress": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as stage, arg_max(value, (ts, event_id)) as value from events group by 1",
    "normalize_log_stream": """select event_id, case when event_id % 5 = 0 then timestamp '2024-03-01 00:00:00' else ts end as ts, case when event_id % 3 = 0 then 'warning' when event_type in ('debug', 'info', 'warning', 'error') then event_type else 'info' end as level, 'miner' as service, null::varchar as source_id, event_type || ' seen' as message, '{"user":"' || user_id || '"' || coalesce(',"k":"' || (props->>'$.k') || '"', '') || '}' as context from events""",
    "baseline_stream": "select user_id, count(value) as n, round(avg(value), 3) as mean, round(stddev_samp(value), 3) as sd from events group by 1",
    "signal_coalesce_stream": "with l as (select *, case when ts - lag(ts) over w < interval '12' hour then 0 else 1 end as new from events window w as (partition by user_id, event_type order by ts, event_id)), r as (select *, sum(new) over (partition by user_id, event_type order by ts, event_id) as run from l) select user_id, event_type, min(ts) as first_at, max(ts) as last_at, count(*) as occurrences from r group by user_id, event_type, run",
    "frontier_state": f"with l as (select user_id, list({_STATE} || '|0' order by ts, event_id) as e from events group by 1), r as (select user_id, list_reduce(list_prepend('discovered|0', e), lambda a, e: case when {_OK} then split_part(e, '|', 1) || '|' || split_part(a, '|', 2) else split_part(a, '|', 1) || '|' || (split_part(a, '|', 2)::int + 1) end) as r from l) select user_id, split_part(r, '|', 1) as state, split_part(r, '|', 2)::int as invalid from r",
    "frontier_state_stream": f"with l as (select user_id, list({_STATE} || '|0' order by ts, event_id) as e from events group by 1), r as (select user_id, list_reduce(list_prepend('discovered|0', e), lambda a, e: case when {_OK} then split_part(e, '|', 1) || '|' || split_part(a, '|', 2) else split_part(a, '|', 1) || '|' || (split_part(a, '|', 2)::int + 1) end) as r from l) select user_id, split_part(r, '|', 1) as state, split_part(r, '|', 2)::int as invalid from r",
    "url_first_seen_stream": "select distinct user_id, event_type from events",
    "usage_stream": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(avg(value), 4) as mean from events group by 1, 2",
}.items()}
