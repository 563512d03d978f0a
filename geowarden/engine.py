"""The engine: rules, objects and readings in, match events out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geowarden.functions.geo import DEGREE_M
from geowarden.lang.check import Compiled, Distance, NearDevices, NearObjects, compile_rule
from geowarden.lang.parser import RuleError
from geowarden.operators import stores
from geowarden.operators.candidates import over_cells
from geowarden.operators.gate import gate_states
from geowarden.plans.detect import Rule, counted, evaluate, events, gated, normalise, policies
from geowarden.sources.geojson import SCHEMA, read_objects

RULES = "rule_id string, spec string, layer_id string, center_lat double, center_lon double, radius double, min_lat double, min_lon double, max_lat double, max_lon double, repeat string, times int, delay_s double, reset_s double, expire_s double, refs array<string>"
STATES = "device_id string, rule_id string, last_seen double, last_reset double, hits int"
LEAST_M = 50.0


def _around(lat: float, lon: float, meters: float) -> tuple[float, float, float, float]:
    from math import cos, radians

    y = meters / DEGREE_M
    x = y / max(cos(radians(lat)), 1e-6)
    return lat - y, lon - x, lat + y, lon + x


class Engine:
    """Holds objects as a DataFrame and rules by id; readings come to detect().

    ``compat`` keeps behaviours that are otherwise set right: comparators as written when a literal
    comes first, hits counted by evaluation, a device meeting its own last position, and IN
    without a distance.  ``before`` is a predicate on (reading, rule_id) columns: where it is true
    the rule is skipped; ``after`` gets the events DataFrame.
    """

    def __init__(self, spark: SparkSession, objects: DataFrame | None = None, compat: bool = False, before: Callable[[Column], Column] | None = None, after: Callable[[DataFrame], None] | None = None) -> None:
        self.spark, self.compat, self.before, self.after = spark, compat, before, after
        self.objects = objects if objects is not None else spark.createDataFrame([], SCHEMA)
        self._rules: dict[str, Rule] = {}
        self.devices: DataFrame | None = None

    # -- objects and devices ------------------------------------------------------------------

    def add_objects(self, rows: DataFrame) -> None:
        """Adds objects from ``object_id, layer_id, geojson``; ids that are there already stay as they are."""
        self.objects = stores.add(self.objects, read_objects(rows), "object_id")

    def delete_objects(self, ids: list[str]) -> None:
        self.objects = stores.delete(self.objects, ids, "object_id")

    def add_devices(self, readings: DataFrame) -> None:
        """Takes readings as last known positions."""
        readings = normalise(readings)
        self.devices = stores.latest(readings) if self.devices is None else stores.upsert(self.devices, readings)

    def delete_devices(self, ids: list[str]) -> None:
        if self.devices is not None:
            self.devices = stores.delete(self.devices, ids, "device_id")

    # -- rules --------------------------------------------------------------------------------

    def add_rule(self, text: str, rule_id: str | None = None) -> str:
        """Compiles and places a rule; its id."""
        compiled = compile_rule(text, self.compat)
        rule_id = rule_id or uuid4().hex
        if rule_id in self._rules:
            raise RuleError(f"there is a rule {rule_id} already")
        self._rules[rule_id] = Rule(rule_id, compiled, self._box(compiled))
        return rule_id

    def delete_rule(self, rule_id: str) -> None:
        self._rules.pop(rule_id, None)

    def restore_rules(self, rows: DataFrame) -> None:
        """Rules from a table with ``rule_id, spec``, as rules() gives it."""
        for r in rows.select("rule_id", "spec").toLocalIterator():
            self.add_rule(r["spec"], r["rule_id"])

    def rule(self, rule_id: str) -> Rule:
        return self._rules[rule_id]

    def every_rule(self) -> list[Rule]:
        return list(self._rules.values())

    def region_ids(self, rule_id: str, size: float = 0.1) -> DataFrame:
        """``cell_y, cell_x`` of the grid cells that a rule's area meets; none if it is looked at everywhere."""
        box = self._rules[rule_id].box
        row = self.spark.createDataFrame([box] if box else [], "y1 double, x1 double, y2 double, x2 double")
        return over_cells(row, size, F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).select("cell_y", "cell_x")

    def states(self, telemetry: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """``device_id, rule_id, last_seen, last_reset, hits`` after readings, going on from the states ``before``: a snapshot that later calls take up."""
        rules = self.every_rule()
        held = {k: v for k, v in policies(rules).items() if v[0] is not None}
        before = before if before is not None else self.spark.createDataFrame([], STATES)
        rows = self.evaluated(telemetry).filter(F.col("rule_id").isin(list(held)))
        both = gate_states(rows, before.filter(F.col("rule_id").isin(list(held))), held, self.compat)
        return both.filter("is_state").select("device_id", "rule_id", "last_seen", "last_reset", "hits")

    @property
    def rules(self) -> DataFrame:
        rows = []
        for r in self._rules.values():
            p = r.compiled.props
            t = p.trigger if p else None
            centre = p.center if p and p.center else r.box and ((r.box[0] + r.box[2]) / 2, (r.box[1] + r.box[3]) / 2) or (None, None)
            rows.append((r.rule_id, r.compiled.text, r.compiled.layer, *centre, p and p.radius, *(r.box or (None,) * 4), t and t.repeat, t and t.times, t and float(t.seconds), float(r.compiled.reset_s), p and p.expire_s, r.compiled.object_refs()))
        return self.spark.createDataFrame(rows, T.StructType.fromDDL(RULES))

    def _box(self, c: Compiled) -> tuple[float, float, float, float] | None:
        """Where a rule is looked at: its own circle, else the box of the objects that every match needs, grown by the distance to them."""
        p = c.props
        if p and p.center:
            return _around(*p.center, max(p.radius or 0.0, LEAST_M))
        spatial = [x for x in c.leaves if isinstance(x, (NearObjects, NearDevices, Distance))]
        tied = isinstance(c.tree, int) or all(isinstance(x, NearObjects) for x in spatial) and not _has_or(c.tree)
        positive = [x for x in spatial if isinstance(x, NearObjects) and not x.every and x.op in ("intersects", "near", "in")]
        if not tied or not positive:
            return None
        ids = [r for x in positive for r in x.refs]
        b = self.objects.filter(F.col("object_id").isin(ids) & (F.col("layer_id") == c.layer)).agg(F.min("min_lat"), F.min("min_lon"), F.max("max_lat"), F.max("max_lon")).first()
        if b[0] is None:
            return None
        grow = max([LEAST_M, *[x.area.meters for x in positive], p and p.radius or 0.0])
        top = max(abs(b[0]), abs(b[2]))
        y1, x1, _, _ = _around(top, 0.0, grow)
        return b[0] - (top - y1), b[1] + x1, b[2] + (top - y1), b[3] - x1

    def reach(self, rule_id: str, center: tuple[float, float], radius: float) -> float:
        """The radius that holds the box of a rule's objects around a centre: three times as large until it does, ten times at most."""
        refs = self._rules[rule_id].compiled.object_refs()
        b = self.objects.filter(F.col("object_id").isin(refs)).agg(F.min("min_lat"), F.min("min_lon"), F.max("max_lat"), F.max("max_lon")).first()
        if b[0] is None:
            raise RuleError("the rule names no object that is known")
        for _ in range(11):
            y1, x1, y2, x2 = _around(*center, radius)
            if y1 <= b[0] and x1 <= b[1] and y2 >= b[2] and x2 >= b[3]:
                return radius
            radius *= 3
        raise RuleError("no radius holds the rule's objects")

    # -- detection ----------------------------------------------------------------------------

    def evaluated(self, telemetry: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Readings with the rules that look at them, before firing policies."""
        readings, seen = self._seen(telemetry, history)
        rules = [replace(r) for r in self._rules.values()]
        if not rules:
            raise RuleError("there are no rules")
        rows = evaluate(readings, self.objects, rules, seen, self.compat)
        return rows if self.before is None else rows.filter(~self.before(F.col("rule_id")))

    def _seen(self, telemetry: DataFrame, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        readings = normalise(telemetry)
        past = self.devices if history is None else normalise(history)
        return readings, readings if past is None else past.unionByName(readings)

    def counts(self, telemetry: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """``event_id, rule_id, n_refs``: how many different targets the matches of detect() name, without listing them where a rule is one leaf between devices."""
        readings, seen = self._seen(telemetry, history)
        out, left = None, []
        for rule in self._rules.values():
            found = counted(readings, rule, seen, self.compat) if self.before is None and self.after is None else None
            if found is None:
                left.append(rule)
                continue
            found = found.select("event_id", F.lit(rule.rule_id).alias("rule_id"), F.col("n").alias("n_refs"))
            out = found if out is None else out.unionByName(found)
        if left or out is None:
            rest = Engine(self.spark, self.objects, self.compat, self.before, self.after)
            rest._rules, rest.devices = {r.rule_id: r for r in left}, self.devices
            refs = F.array_distinct(F.flatten(F.transform("match", lambda m: F.coalesce(m["right"]["refs"], F.array().cast("array<string>")))))
            found = rest.detect(telemetry, history).select("event_id", F.col("rule.rule_id").alias("rule_id"), F.size(refs).cast("long").alias("n_refs"))
            out = found if out is None else out.unionByName(found)
        return out

    def detect(self, telemetry: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Match events of readings in the order of their time: ``event_id, device, date_time, rule, match``.

        A reading sees other devices where they were before it, in ``history`` (or the devices
        added) and among the readings themselves.
        """
        found = events(gated(self.evaluated(telemetry, history), list(self._rules.values()), self.compat))
        if self.after is not None:
            self.after(found)
        return found


def _has_or(tree: object) -> bool:
    return not isinstance(tree, int) and (tree[0] == "or" or _has_or(tree[1]) or _has_or(tree[2]))
