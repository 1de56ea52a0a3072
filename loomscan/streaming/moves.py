"""A state machine over keyed events, folded as maps from states to states.

An event takes each state to a next one, itself where the move is not allowed, with a count of such events. Those maps are
composed like functions, in any grouping that keeps the order: chunks of consecutive events, of many short keys or of part of
a long one, are folded apart, the maps of a key that several chunks hold are met in order, and each chunk is read once more
from the states its keys begin in to judge every event.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomscan.plans.shared import materialize

#: The moves that a frontier row may make.
MOVES = {"discovered": ("queued", "skipped"), "queued": ("fetching", "skipped"), "fetching": ("fetched", "failed"), "failed": ("queued",), "fetched": ("queued",), "skipped": ("queued",)}
CHUNK = 1 << 15
FAN_IN = 256


class Machine:
    """States by number. A map is (next state, invalid events) for each state, as two lists."""

    def __init__(self, moves: dict[str, tuple[str, ...]] = MOVES):
        self.names = sorted(moves)
        self.number = {s: k for k, s in enumerate(self.names)}
        self.moves = {(self.number[a], b): self.number[b] for a, to in moves.items() for b in to}

    def step(self, state: int, event: str | None) -> tuple[int, int]:
        to = self.moves.get((state, event))
        return (state, 1) if to is None else (to, 0)

    def known(self) -> "Known":
        return Known(self)

    def chunk_map(self, events: list[str | None], known: "Known | None" = None) -> tuple[list[int], list[int]]:
        """The map of events in order."""
        to, bad = list(range(len(self.names))), [0] * len(self.names)
        known = self.known() if known is None else known
        for e in events:
            row = known[e]
            for s, at in enumerate(to):
                to[s], more = row[at]
                bad[s] += more
        return to, bad

    @staticmethod
    def composed(first: tuple[list[int], list[int]], then: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        return [then[0][s] for s in first[0]], [n + then[1][s] for s, n in zip(first[0], first[1], strict=True)]


class Known(dict):
    """What an event does to each state, by event, worked out when it is first met."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.machine = machine

    def __missing__(self, event: str | None) -> list[tuple[int, int]]:
        self[event] = [self.machine.step(s, event) for s in range(len(self.machine.names))]
        return self[event]


def _chunked(events: DataFrame, chunk: int) -> DataFrame:
    """events (key, ts, event_id, state), written, with part and block: `chunk` consecutive rows of the order by key and time at most. A key that is in several blocks is the first or last in each."""
    cut = events.repartitionByRange("key", "ts", "event_id", "state").sortWithinPartitions("key", "ts", "event_id", "state")
    rows = cut.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"))
    return materialize(rows.withColumn("block", F.floor(F.col("seq") / chunk)), "events")


def _maps(machine: Machine):
    """Of a block's rows, in order: the map of each key's."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.sort_by("seq")
        known = machine.known()
        keys, to, bad = [], [], []
        for key, own in groupby(zip(rows["key"].to_pylist(), rows["state"].to_pylist(), strict=True), lambda r: r[0]):
            states, counts = machine.chunk_map([e for _, e in own], known)
            keys.append(key)
            to.append(states)
            bad.append(counts)
        same = [pa.array([rows[c][0].as_py()] * len(keys), t) for c, t in (("part", pa.int32()), ("block", pa.int64()))]
        return pa.Table.from_arrays([pa.array(keys, pa.int64()), *same, pa.array(to, pa.list_(pa.int32())), pa.array(bad, pa.list_(pa.int64()))], names=["key", "part", "block", "to", "bad"])

    return work


def _folded(machine: Machine, start: int, entry: bool):
    """Of a group's maps in order: their composition, or with entry the state and count before each."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("block", "ascending")])
        now = (list(range(len(machine.names))), [0] * len(machine.names))
        before = []
        for to, bad in zip(rows["to"].to_pylist(), rows["bad"].to_pylist(), strict=True):
            before.append(now)
            now = machine.composed(now, (to, bad))
        if entry:
            at = rows["at"][0].as_py() if "at" in rows.column_names else start
            return pa.table({"key": rows["key"], "part": rows["part"], "block": rows["block"], "at": pa.array([b[0][at] for b in before], pa.int32())})
        return pa.table({"key": rows["key"][:1], "part": rows["part"][:1], "block": rows["block"][:1], "to": pa.array([now[0]], pa.list_(pa.int32())), "bad": pa.array([now[1]], pa.list_(pa.int64()))})

    return work


_MAP = "key long, part int, block long, to array<int>, bad array<long>"


def _grouped(maps: DataFrame, fan_in: int) -> DataFrame:
    """maps with group: so many of a key's maps at a time, in order."""
    w = Window.partitionBy("key").orderBy("part", "block")
    return maps.withColumn("group", F.floor((F.row_number().over(w) - 1) / fan_in))


def fold(events: DataFrame, start: str = "discovered", moves: dict[str, tuple[str, ...]] = MOVES, chunk: int = CHUNK, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """Two tables of events (key, ts, event_id, state): (key, state, invalid), and one row an event, (key, ts, event_id, before, event, after, valid).

    Events of a key count by time, then id, then state (null first). An event that its key's state doesn't allow, or that names none, leaves the state as it is.
    No call holds more than a chunk of events; only keys of several chunks, two a chunk at most, have maps to meet, fan_in at a time, level by level.
    """
    machine = Machine(moves)
    first = machine.number[start]
    rows = _chunked(events.select("key", "ts", "event_id", "state"), chunk)
    maps = rows.select("key", "part", "block", "seq", "state").groupBy("part", "block").applyInArrow(_maps(machine), _MAP)
    every = materialize(maps.withColumn("n", F.count("*").over(Window.partitionBy("key"))), "maps")
    levels = [every.where("n > 1").drop("n")]
    while (levels[-1].groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1:
        levels.append(materialize(_grouped(levels[-1], fan_in).groupBy("key", "group").applyInArrow(_folded(machine, 0, False), _MAP), "maps"))
    last = every.where("n = 1").drop("n").unionByName(levels[-1]).select("key", F.element_at("to", first + 1).alias("to"), F.element_at("bad", first + 1).alias("invalid"))
    names = F.array(*map(F.lit, machine.names))
    ends = last.select("key", F.element_at(names, F.col("to") + 1).alias("state"), F.col("invalid").cast("int").alias("invalid"))

    entered = levels[-1].select("key", "part", "block", F.lit(first).alias("at"))
    for below in reversed(levels[:-1]):  # the state before a map is that before the first of its group, taken on by those ahead of it
        g, e = _grouped(below, fan_in).alias("g"), entered.alias("e")
        met = g.join(e, F.col("g.key").eqNullSafe(F.col("e.key")) & (F.col("g.part") == F.col("e.part")) & (F.col("g.block") == F.col("e.block")), "left").select("g.*", F.max("e.at").over(Window.partitionBy("g.key", "g.group")).alias("at"))
        entered = materialize(met.groupBy("key", "group").applyInArrow(_folded(machine, first, True), "key long, part int, block long, at int"), "entered")

    def judge(block: pa.Table, entries: pa.Table) -> pa.Table:
        t = block.sort_by("seq")
        begin = dict(zip(entries["key"].to_pylist(), entries["at"].to_pylist(), strict=True))
        known = machine.known()
        before, after, valid = [], [], []
        for key, own in groupby(zip(t["key"].to_pylist(), t["state"].to_pylist(), strict=True), lambda r: r[0]):
            at = begin.get(key, first)
            for _, event in own:
                before.append(machine.names[at])
                at, bad = known[event][at]
                after.append(machine.names[at])
                valid.append(not bad)
        return pa.table({"key": t["key"], "ts": t["ts"], "event_id": t["event_id"], "before": pa.array(before, pa.string()), "event": t["state"], "after": pa.array(after, pa.string()), "valid": pa.array(valid, pa.bool_())})

    kind = dict(rows.dtypes)["ts"]
    judged = rows.groupBy("part", "block").cogroup(entered.groupBy("part", "block")).applyInArrow(judge, f"key long, ts {kind}, event_id long, before string, event string, after string, valid boolean")
    return ends, judged


def fold_stream(events: DataFrame, start: str = "discovered", moves: dict[str, tuple[str, ...]] = MOVES) -> DataFrame:
    """(key, state, invalid) of a stream of events (key, ts, event_id, state) in update mode: each micro-batch folds its events of a key, in order, to a map, which takes the kept state on."""
    machine = Machine(moves)

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, bad = state.get if state.exists else (machine.number[start], 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id", "state"], na_position="first")
        to, more = machine.chunk_map([None if pd.isna(x) else x for x in rows["state"]])
        at, bad = to[at], bad + more[at]
        state.update((at, bad))
        yield pd.DataFrame({"key": [key[0]], "state": [machine.names[at]], "invalid": [bad]})

    return events.groupBy("key").applyInPandasWithState(work, "key long, state string, invalid int", "at int, invalid long", "update", GroupStateTimeout.NoTimeout)
