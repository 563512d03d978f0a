"""Firing policies: an ordered fold over the readings of each (device, rule), one state in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geowarden.lang.ast import Trigger


@dataclass
class State:
    """Moments in seconds; None before the first."""

    last_seen: float | None = None
    last_reset: float | None = None
    hits: int = 0


def step(state: State, now: float, ok: bool, trigger: Trigger | None, reset_s: float, compat: bool = False) -> bool:
    """Moves a state on by one reading; whether the rule fires.

    A period begins with the first reading and again with the first one ``reset_s`` after its
    start.  once: one firing a period; N times interval d: up to N, d apart; every d: firings at
    least d apart.  Hits count firings; with ``compat`` they count evaluations, and ``every``
    passes whenever more than d has gone by since the period began.
    """
    if reset_s == 0 or state.last_reset is None or now - state.last_reset >= reset_s:
        state.hits, state.last_seen, state.last_reset = 0, None, now
    waited = state.last_seen is None or trigger is not None and now - state.last_seen >= trigger.seconds
    if trigger is None:
        passes = True
    elif trigger.repeat == "once":
        passes = state.hits == 0
    elif trigger.repeat == "times":
        passes = waited and state.hits < trigger.times
    else:
        passes = waited if not compat else state.last_seen is None or now - state.last_reset > trigger.seconds
    fires = passes and ok
    if passes and (ok or compat):
        state.last_seen = now
        state.hits += 1
    return fires


def remove_states(states: DataFrame, device_id: str | None = None, rule_id: str | None = None) -> DataFrame:
    """States without those of a device, of a rule, or of the one key that both name."""
    if device_id is None and rule_id is None:
        return states
    gone = F.lit(True)
    for c, v in (("device_id", device_id), ("rule_id", rule_id)):
        gone = gone & (F.col(c) == v) if v is not None else gone
    return states.filter(~gone)


def lookup_state(states: DataFrame, device_id: str, rule_id: str) -> DataFrame:
    return states.filter((F.col("device_id") == device_id) & (F.col("rule_id") == rule_id))


def visits(hits: DataFrame) -> DataFrame:
    """``device_id, rule_id, object_id, last_visit`` (seconds): when each device last met each object, from events."""
    each = hits.select(F.col("device.device_id").alias("device_id"), F.col("rule.rule_id").alias("rule_id"), F.unix_timestamp("date_time").alias("t"), F.explode(F.flatten(F.transform("match", lambda m: F.coalesce(m["right"]["refs"], F.array().cast("array<string>"))))).alias("object_id"))
    return each.groupBy("device_id", "rule_id", "object_id").agg(F.max("t").alias("last_visit"))


def gate(rows: DataFrame, policies: dict[str, tuple[Trigger | None, float]], compat: bool = False) -> DataFrame:
    """The rows of ``rows`` (device_id, rule_id, ok, now, event_id and others) that fire.

    Rows of a key come sorted in one partition and are folded as a stream, so a device with any
    number of readings needs the memory of one state.
    """
    names = rows.columns
    at = {c: names.index(c) for c in ("device_id", "rule_id", "ok", "now")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, State()
        for batch in batches:
            fired = []
            for device, rule, ok, now in zip(*(batch.column(at[c]).to_pylist() for c in ("device_id", "rule_id", "ok", "now")), strict=True):
                if (device, rule) != key:
                    key, state = (device, rule), State()
                fired.append(step(state, now, ok, *policies[rule], compat))
            yield batch.filter(pa.array(fired))

    return rows.repartition("device_id", "rule_id").sortWithinPartitions("device_id", "rule_id", "now", "event_id").mapInArrow(run, rows.schema)


def gate_states(rows: DataFrame, before: DataFrame, policies: dict[str, tuple[Trigger | None, float]], compat: bool = False) -> DataFrame:
    """gate() that goes on from the states ``before`` and returns them too: ``fired`` rows and one row of state per key.

    ``before`` has device_id, rule_id, last_seen, last_reset, hits.  States come back as rows with
    ``is_state`` true, in the columns last_seen, last_reset and hits.
    """
    names = [*rows.columns, "is_state", "last_seen", "last_reset", "hits"]
    none = F.lit(None)
    first = before.select(*[F.col(c) if c in ("device_id", "rule_id") else none.cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(True).alias("is_state"), "last_seen", "last_reset", "hits")
    rest = rows.select("*", F.lit(False).alias("is_state"), none.cast("double").alias("last_seen"), none.cast("double").alias("last_reset"), none.cast("int").alias("hits"))
    at = {c: names.index(c) for c in ("device_id", "rule_id", "ok", "now", "is_state", "last_seen", "last_reset", "hits")}
    both = first.unionByName(rest)

    def state_row(schema: pa.Schema, key: tuple, s: State) -> pa.RecordBatch:
        mine = {"device_id": key[0], "rule_id": key[1], "is_state": True, "last_seen": s.last_seen, "last_reset": s.last_reset, "hits": s.hits}
        return pa.RecordBatch.from_arrays([pa.array([mine.get(f.name)], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, schema = None, State(), None
        for batch in batches:
            schema, fired = batch.schema, []
            ended: list[pa.RecordBatch] = []
            for device, rule, ok, now, is_state, seen, reset, hits in zip(*(batch.column(at[c]).to_pylist() for c in at), strict=True):
                if (device, rule) != key:
                    if key is not None:
                        ended.append(state_row(schema, key, state))
                    key, state = (device, rule), State()
                if is_state:
                    state = State(seen, reset, hits)
                    fired.append(False)
                else:
                    fired.append(step(state, now, ok, *policies[rule], compat))
            yield batch.filter(pa.array(fired))
            yield from ended
        if key is not None:
            yield state_row(schema, key, state)

    order = ["device_id", "rule_id", F.col("is_state").desc(), "now", "event_id"]
    return both.repartition("device_id", "rule_id").sortWithinPartitions(*order).mapInArrow(run, both.schema)
