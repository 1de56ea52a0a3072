"""Streams in several micro-batches, replayed ones, and the state machine against a sequential fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomscan.plans.shared import new_path
from loomscan.streaming import moves, streams

T = dt.datetime(2024, 1, 1)
KINDS = ["view", "click", "purchase", "error", "signup", "odd"]


@pytest.fixture
def files(spark):
    """Three event files, in order of time, of users of whom some are in one file only."""
    rnd = random.Random(7)
    rows = [(i, T + dt.timedelta(minutes=i), rnd.randrange(6) if i % 50 else 100 + i // 50, rnd.choice(KINDS), None if i % 17 == 0 else float(rnd.randrange(100)), None) for i in range(240)]
    at = new_path(spark, "in")
    for k in range(3):
        path = f"{at}/events-{k}"
        spark.createDataFrame(rows[80 * k : 80 * k + 80], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    return at, rows


def stream(spark, at):
    raw = spark.readStream.option("maxFilesPerTrigger", 1).schema(streams.EVENTS).parquet(f"{at}/events-*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def test_updates_of_three_batches_give_the_batch_answer(spark, files):
    at, rows = files
    got = {r["user_id"]: (r["n"], r["mean"], r["sd"]) for r in streams.run_to_end(streams.running_baseline(stream(spark, at)), "baseline", "update", ["user_id"]).collect()}
    want = {r["user_id"]: (r["n"], r["mean"], r["sd"]) for r in spark.read.parquet(f"{at}/events-*").groupBy("user_id").agg(F.count("value").alias("n"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 3).alias("mean"), F.round(F.stddev("value"), 3).alias("sd")).collect()}
    assert got == {k: tuple(x if x is None else pytest.approx(x, abs=2e-3) for x in v) for k, v in want.items()} and len(got) > 8


def test_a_replayed_batch_changes_nothing(spark):
    out, rows = new_path(spark, "sink"), lambda x: spark.createDataFrame(x, "k string, v int")
    write, batches = streams.versioned(out), [[("a", 1), ("b", 1)], [("a", 2)], [("c", 3), ("b", 3)]]
    for n in (0, 1, 2, 1, 2):
        write(rows(batches[n]), n)
    got = lambda keys: sorted(map(tuple, streams.newest(spark, out, rows([]).schema, keys).collect()))
    assert got(["k"]) == [("a", 2), ("b", 3), ("c", 3)] and got(None) == [("b", 3), ("c", 3)]


def test_silent_keys(spark):
    at = new_path(spark, "in")
    for k, minutes in enumerate([[(1, 0), (2, 0)], [(1, 1), (3, 1)], [(4, 30)], [(4, 31)]]):
        spark.createDataFrame([(10 * k + i, T + dt.timedelta(minutes=m), u, "view", 1.0, None) for i, (u, m) in enumerate(minutes)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events-{k}")
    got = {(r["user_id"], r["last_ms"] // 60_000 % 60) for r in streams.run_to_end(streams.stale_keys(stream(spark, at)), "stale").collect()}
    assert got == {(1, 1), (2, 0), (3, 1)}


def test_logs_of_a_stream(spark, sf_dir):
    df = streams.QUERIES["normalize_log_stream"](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def sequential(rows):
    ends, judged = {}, []
    for key in sorted({r[0] for r in rows}):
        state, bad = "discovered", 0
        for _, ts, event_id, event in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3] is not None, r[3] or "")):
            ok = event in moves.MOVES.get(state, ())
            after = event if ok else state
            judged.append((key, event_id, state, event, after, ok))
            state, bad = after, bad + (not ok)
        ends[key] = (state, bad)
    return ends, judged


@pytest.mark.parametrize(("chunk", "fan_in"), [(7, 2), (40, 3), (1 << 15, 256)])
def test_maps_compose_to_the_sequential_fold(spark, chunk, fan_in):
    rnd = random.Random(chunk)
    rows = [(0 if i % 3 else rnd.randrange(9), T + dt.timedelta(seconds=rnd.randrange(300)), i, rnd.choice([*moves.MOVES, "odd", None])) for i in range(700)]
    ends, judged = moves.fold(spark.createDataFrame(rows, "key long, ts timestamp, event_id long, state string"), chunk=chunk, fan_in=fan_in)
    want_ends, want = sequential(rows)
    assert {r["key"]: (r["state"], r["invalid"]) for r in ends.collect()} == want_ends
    assert sorted(map(str, ((r["key"], r["event_id"], r["before"], r["event"], r["after"], r["valid"]) for r in judged.collect()))) == sorted(map(str, want))


def test_short_keys_share_a_call_and_events_without_a_key_count(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(200)]) if i % 2 else None, T + dt.timedelta(seconds=rnd.randrange(300)), i, rnd.choice([*moves.MOVES, "odd", None])) for i in range(900)]
    ends, judged = moves.fold(spark.createDataFrame(rows, "key long, ts timestamp, event_id long, state string"), chunk=50, fan_in=3)
    want_ends, want = sequential([(-1 if r[0] is None else r[0], *r[1:]) for r in rows])
    assert {-1 if r["key"] is None else r["key"]: (r["state"], r["invalid"]) for r in ends.collect()} == want_ends
    got = judged.collect()  # before, those without a key were left out
    assert sorted(map(str, ((-1 if r["key"] is None else r["key"], r["event_id"], r["before"], r["event"], r["after"], r["valid"]) for r in got))) == sorted(map(str, want))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(key" not in plan.split("FlatMapCoGroupsInArrow")[1].split("Exchange")[1]  # before, a call for each key


def test_no_events(spark):
    ends, judged = moves.fold(spark.createDataFrame([], "key long, ts timestamp, event_id long, state string"))
    assert ends.count() == judged.count() == 0


def test_composition_is_associative():
    machine, rnd = moves.Machine(), random.Random(1)
    maps = [machine.chunk_map([rnd.choice([*moves.MOVES, None]) for _ in range(5)]) for _ in range(12)]
    for a, b, c in zip(maps, maps[1:], maps[2:], strict=False):
        assert machine.composed(machine.composed(a, b), c) == machine.composed(a, machine.composed(b, c))


def test_states_of_a_stream_in_three_batches(spark, files):
    at, rows = files
    events = [(u, t, i, streams.STATES.get(k)) for i, t, u, k, _, _ in rows]
    got = streams.run_to_end(moves.fold_stream(streams._as_states(stream(spark, at))), "moves", "update", ["key"]).collect()
    assert {r["key"]: (r["state"], r["invalid"]) for r in got} == sequential(events)[0]
