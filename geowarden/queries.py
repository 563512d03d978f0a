"""Queries of the engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geowarden.engine import Engine
from geowarden.functions.geo import boundary, clamped, relations
from geowarden.lang.check import TypeErrorInRule, compile_rule
from geowarden.lang.parser import ParseError
from geowarden.operators import stores
from geowarden.operators.gate import lookup_state, remove_states, visits
from geowarden.sources import geojson, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
M = 111194.92664455873


def _rule(name: str, text: str, sql: str | None, layers: bool = False, spread: bool = False, coarse: bool = False, columns: tuple[str, ...] = ("event_id",), **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, tables.objects(spark, sf_dir, layers), **options)
        engine.add_rule(text, name)
        readings = tables.telemetry(spark, sf_dir, layers, spread, coarse)
        if columns == ("event_id", "n_refs"):
            return engine.counts(readings).select(*columns)
        found = engine.detect(readings)
        refs = F.array_join(_refs(), ",")
        return found.select(*[{"event_id": F.col("event_id"), "refs": refs.alias("refs"), "matches": _told().alias("matches")}[c] for c in columns])

    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _refs() -> Column:
    """Ids of all matches, sorted and once each; those of one match are so already."""
    none = F.array().cast("array<string>")
    every = F.flatten(F.transform("match", lambda m: F.coalesce(m["right"]["refs"], none)))
    return F.when(F.size("match") == 1, F.coalesce(F.get("match", F.lit(0))["right"]["refs"], none)).otherwise(F.array_sort(F.array_distinct(every)))


def _told() -> Column:
    """Operator, position and keywords of every match, in order."""
    return F.array_join(F.transform("match", lambda m: F.concat_ws(":", m["operator"], m["pos"].cast("string"), m["left"]["keyword"], m["right"]["keyword"])), " ")


def _scalar(name: str, text: str, where: str, spread: bool = False, coarse: bool = False, **options) -> None:
    _rule(name, text, f"WITH r AS ({tables.telemetry_sql(spread=spread, coarse=coarse)}) SELECT event_id FROM r WHERE {where}", spread=spread, coarse=coarse, **options)


_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "lte": "<=", "gte": ">="}
_NOON = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
for _op, _sign in _SIGNS.items():
    _scalar(f"cmp_int_{_op}", f"speed {_op} 40", f"CAST(trunc(speed) AS BIGINT) {_sign} 40")
    _scalar(f"cmp_float_{_op}", f"speed {_op} 40.5", f"speed {_sign} 40.5")
    _scalar(f"cmp_str_{_op}", f'model {_op} "error"', f"model {_sign} 'error'")
    _scalar(f"cmp_time_{_op}", f"time {_op} 12:30", f"{_NOON} {_sign} 45000", coarse=True)
    _scalar(f"cmp_mirrored_{_op}", f"40 {_op} speed", f"40 {_sign} CAST(trunc(speed) AS BIGINT)")
_scalar("in_int", "temperature in [-5, 0, 5, 41]", "CAST(trunc(temperature) AS BIGINT) IN (-5, 0, 5, 41)")
_scalar("nin_int", "status nin [1, 2, 3, 50]", "status NOT IN (1, 2, 3, 50)")
_scalar("in_float", "battery in [1.0, 17.0, 99.0]", "battery IN (1.0, 17.0, 99.0)")
_scalar("nin_float", "battery nin [1.0, 17.0, 99.0]", "battery NOT IN (1.0, 17.0, 99.0)")
_scalar("in_str", 'brand in ["BUILDING", "MACHINERY"]', "brand IN ('BUILDING', 'MACHINERY')")
_scalar("nin_str", 'model nin ["view", "click"]', "model NOT IN ('view', 'click')")
_scalar("in_month_name", 'month in ["May", "August"]', "monthname(ts) IN ('May', 'August')", spread=True)
_scalar("in_weekday_name", 'day in ["Sunday", "Monday"]', "dayname(ts) IN ('Sunday', 'Monday')")
_scalar("range_int", "speed range [30 .. 120]", "CAST(trunc(speed) AS BIGINT) BETWEEN 30 AND 120")
_scalar("nrange_int", "speed nrange [30 .. 120]", "CAST(trunc(speed) AS BIGINT) <= 30 OR CAST(trunc(speed) AS BIGINT) >= 120")
_scalar("range_float", "speed range [30.5 .. 120.25]", "speed BETWEEN 30.5 AND 120.25")
_scalar("nrange_float", "battery nrange [10.0 .. 90.0]", "battery <= 10 OR battery >= 90")
_scalar("range_time", "time range [08:15 .. 17:45]", f"{_NOON} BETWEEN 29700 AND 63900")
_scalar("nrange_time", "time nrange [08:15 .. 17:45]", f"{_NOON} <= 29700 OR {_NOON} >= 63900")
_scalar("range_date", 'date range ["2024-05-01" .. "2024-08-15"]', "t BETWEEN 1714521600 AND 1723680000", spread=True)
_scalar("nrange_date", 'date nrange ["2024-05-01" .. "2024-08-15"]', "t <= 1714521600 OR t >= 1723680000", spread=True)
_scalar("range_datetime", 'datetime range ["2024-05-01T06:00:00+00:00" .. "2024-08-15T20:00:00+02:00"]', "t BETWEEN 1714543200 AND 1723744800", spread=True)
_scalar("nrange_datetime", 'datetime nrange ["2024-05-01T06:00:00+00:00" .. "2024-08-15T20:00:00+02:00"]', "t <= 1714543200 OR t >= 1723744800", spread=True)
_scalar("cmp_datetime", 'datetime gte "2024-05-01T06:00:00+00:00"', "t >= 1714543200", spread=True)
_scalar("cal_year", "year eq 2025", "year(ts) = 2025", spread=True)
_scalar("cal_month", "month range [3 .. 5]", "month(ts) BETWEEN 3 AND 5", spread=True)
_scalar("cal_isoweek", "week in [1, 17, 52]", "weekofyear(ts) IN (1, 17, 52)", spread=True)
_scalar("cal_day", "day lte 7", "day(ts) <= 7")
_scalar("cal_hour", "hour in [8, 9, 17, 18]", "hour(ts) IN (8, 9, 17, 18)")
_scalar("cal_date_text", 'date lt "2024-03-01"', "strftime(ts, '%Y-%m-%d') < '2024-03-01'", spread=True)
_I = "CAST(trunc({}) AS BIGINT)".format
_scalar("sensor_fuel_level", "fuelLevel lt 20", f"{_I('fuel_level')} < 20")
_scalar("sensor_pressure", "pressure range [960.5 .. 990.5]", "pressure BETWEEN 960.5 AND 990.5")
_scalar("sensor_luminosity", "luminosity gte 500.5", "luminosity >= 500.5")
_scalar("sensor_humidity", "humidity in [10, 20, 30]", f"{_I('humidity')} IN (10, 20, 30)")
_scalar("sensor_temperature", "temperature lte -5", f"{_I('temperature')} <= -5")
_scalar("text_imei", 'imei in ["35-3", "35-7"]', "imei IN ('35-3', '35-7')")
_scalar("text_owner", 'owner ne "Customer#000000012"', "owner <> 'Customer#000000012'")
_scalar("before_hook", "speed gt 20", f"{_I('speed')} > 20 AND status >= 50", before=lambda rule: (rule == "before_hook") & (F.col("status") < 50))
_scalar("compat_mirrored", "40 lt speed", f"{_I('speed')} < 40", compat=True)
_scalar("bool_and", "speed range [30 .. 120] AND hour IN [8, 9, 17, 18]", f"{_I('speed')} BETWEEN 30 AND 120 AND hour(ts) IN (8, 9, 17, 18)")
_scalar("bool_or", "speed lt 10 OR battery gt 95", f"{_I('speed')} < 10 OR battery > 95")
_scalar("bool_paren_mixed", '(speed lt 30 OR battery gt 80) AND (model eq "view" OR model eq "click")', f"({_I('speed')} < 30 OR battery > 80) AND model IN ('view', 'click')")
_scalar("bool_precedence", 'speed lt 30 OR battery gt 80 AND model eq "view" OR temperature eq 0', f"{_I('speed')} < 30 OR (battery > 80 AND model = 'view') OR temperature = 0")

# -- shapes in SQL: edges of areas and objects -------------------------------------------------


def _ring_sql(shape: str | None, meters: float, lat: str, lon: str) -> str:
    """List of (y, x) of an area's corners, closed."""
    if shape is None:
        return f"[{{'y': {lat}, 'x': {lon}}}]"
    if shape == "bbox":
        y, x = f"{meters} / {M}", f"{meters} / {M} / greatest(cos(radians({lat})), 1e-6)"
        at = [("-", "-"), ("-", "+"), ("+", "+"), ("+", "-"), ("-", "-")]
        return "[" + ", ".join(f"{{'y': {lat} {a} {y}, 'x': {lon} {b} {x}}}" for a, b in at) + "]"
    d = meters / 6371000.0
    y = f"asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians(-30.0 * k)))"
    return f"list_transform(range(0, 13), lambda k: {{'y': degrees({y}), 'x': degrees(radians({lon}) + atan2(sin(radians(-30.0 * k)) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin({y})))}})"


def _cross_sql(o: str, a: str, b: str) -> str:
    return f"(({a}x - {o}x) * ({b}y - {o}y) - ({a}y - {o}y) * ({b}x - {o}x))"


_MEET = f"""greatest(a.y, a.y2) >= least(b.y, b.y2) AND greatest(b.y, b.y2) >= least(a.y, a.y2) AND greatest(a.x, a.x2) >= least(b.x, b.x2) AND greatest(b.x, b.x2) >= least(a.x, a.x2)
  AND ((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * ((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) <= 0
  AND ((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * ((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) <= 0"""


def _left_of(p: str, e: str) -> str:
    """Which side of an edge a point is on; all edges of a convex ring agree for what is inside."""
    return f"({e}.x2 - {e}.x) * ({p}.y - {e}.y) - ({e}.y2 - {e}.y) * ({p}.x - {e}.x)"


def _pairs_sql(candidates: str, mine: str, theirs: str) -> str:
    """CTEs over ``cand(event_id, other, lat, lon, ...)``: facts(event_id, other, meets, within, holds) of ring A = mine and ring B = theirs.

    ``within``: B lies in A; ``holds``: A lies in B.
    """
    edge = lambda ring: f"SELECT event_id, other, {ring}[i].y AS y, {ring}[i].x AS x, {ring}[least(i + 1, len({ring}))].y AS y2, {ring}[least(i + 1, len({ring}))].x AS x2, len({ring}) > 1 AS wide FROM rings, range(1, greatest(len({ring}), 2)) t(i)"
    side = lambda p, e: f"SELECT p.event_id, p.other, p.y, p.x, bool_and({_left_of('p', 'e')} >= 0) OR bool_and({_left_of('p', 'e')} <= 0) AS inside FROM {p} p JOIN {e} e USING (event_id, other) WHERE e.wide GROUP BY ALL"
    return f"""cand AS ({candidates}), rings AS (SELECT event_id, other, {mine} AS a, {theirs} AS b FROM cand),
    a AS MATERIALIZED ({edge("a")}), b AS MATERIALIZED ({edge("b")}),
    b_in AS ({side("b", "a")}), a_in AS ({side("a", "b")}),
    crossing AS (SELECT event_id, other, bool_or({_MEET}) AS c FROM a JOIN b USING (event_id, other) GROUP BY ALL),
    bi AS (SELECT event_id, other, bool_and(inside) AS every, bool_or(inside) AS any FROM b_in GROUP BY ALL),
    ai AS (SELECT event_id, other, bool_and(inside) AS every, bool_or(inside) AS any FROM a_in GROUP BY ALL),
    facts AS (SELECT event_id, other, c OR coalesce(bi.any, false) OR coalesce(ai.any, false) AS meets, coalesce(bi.every, false) AS within, coalesce(ai.every, false) AS holds
      FROM crossing LEFT JOIN bi USING (event_id, other) LEFT JOIN ai USING (event_id, other))"""


_TEST = {"intersects": "meets", "nintersects": "NOT meets", "near": "meets OR within", "nnear": "NOT within OR NOT meets", "in": "within", "nin": "NOT within"}
_AREAS = {"point": (None, 0.0), "bbox": ("bbox", 1500.0), "radius": ("radius", 1500.0)}
_REFS = "SELECT event_id, string_agg(other, ',' ORDER BY other) AS refs"
_SOME = "n0 n6 n12 n18 n24 n7".split()


def _object_sql(op: str, shape: str | None, meters: float, every: bool, layers: bool = False, layer: str = "", only: str = "true", also: list[str] | None = None) -> str:
    m = meters or 50.0
    y, x = f"{m} / {M}", f"{m} / {M} / cos(radians(lat))"
    where = f"max(o.y) >= r.lat - {y} AND min(o.y) <= r.lat + {y} AND max(o.x) >= r.lon - {x} AND min(o.x) <= r.lon + {x}" if every else "true"
    ids = "" if every else f"AND o.object_id IN ({', '.join(repr(k) for k in _SOME)})"
    where = f"{where} OR any_value(o.object_id) IN ({', '.join(map(repr, also))})" if also else where
    cand = f"SELECT r.event_id, o.object_id AS other, r.lat, r.lon, list({{'y': o.y, 'x': o.x}} ORDER BY o.i) AS ring FROM r JOIN o ON o.layer_id = r.layer_id {ids} WHERE r.layer_id = '{layer}' AND {only} GROUP BY ALL HAVING {where}"
    test = "meets" if shape is None and op == "in" else "NOT meets" if shape is None and op == "nin" else _TEST[op]
    return f"WITH r AS ({tables.telemetry_sql(layers)}), o AS ({tables.corners_sql(layers)}), {_pairs_sql(cand, _ring_sql(shape, meters, 'lat', 'lon'), 'ring')} {_REFS} FROM facts WHERE {test} GROUP BY event_id"


def _area_text(shape: str | None, meters: float) -> str:
    return f" :{shape} {int(meters)}m" if shape else ""


for _op in _TEST:
    for _name, (_shape, _m) in _AREAS.items():
        _target = "polygon(@)" if _op in ("intersects", "near", "in") else f"polygon({', '.join(_SOME)})"
        _rule(f"{_op}_obj_{_name}", f"device{_area_text(_shape, _m)} {_op} {_target}", _object_sql(_op, _shape, _m, "@" in _target), columns=("event_id", "refs"))
_rule("match_refs", f"objects({', '.join(_SOME)}) NEAR device :radius 1500m", _object_sql("near", "radius", 1500.0, False), columns=("event_id", "refs"))
_rule("layer_isolation", "device INTERSECTS polygon(@) { :layer L3 }", _object_sql("intersects", None, 0.0, True, True, "L3"), layers=True, columns=("event_id", "refs"))

_PEERS = "d3 d17 d42".split()
_OURS = f"device_id IN ({', '.join(map(repr, _PEERS))})"
for _op in ("nintersects", "nnear", "nin"):
    _rule(f"{_op}_obj_every", f"device :bbox 1500m {_op} polygon(@)", _object_sql(_op, "bbox", 1500.0, True), columns=("event_id", "refs"))
_rule("only_devices_obj", f"devices({', '.join(_PEERS)}) :radius 1500m INTERSECTS polygon(@)", _object_sql("intersects", "radius", 1500.0, True, only=_OURS), columns=("event_id", "refs"))
_rule("obj_only_devices", f"polygon({', '.join(_SOME)}) NIN devices({', '.join(_PEERS)}) :bbox 1500m", _object_sql("nin", "bbox", 1500.0, False, only=_OURS), columns=("event_id", "refs"))
_rule("every_and_named_obj", "device :bbox 1500m NNEAR polygon(@, n0, n24)", _object_sql("nnear", "bbox", 1500.0, True, also=["n0", "n24"]), columns=("event_id", "refs"))
_rule("match_told", "multiPoint(@) INTERSECTS device AND speed GT 40", _object_sql("intersects", None, 0.0, True).replace("string_agg(other, ',' ORDER BY other) AS refs", "'intersects:14:device:multiPoint gt:42:speed:int' AS matches").replace("WHERE meets", f"JOIN r USING (event_id) WHERE meets AND {_I('speed')} > 40"), columns=("event_id", "matches"))

_BEFORE = "h AS (SELECT *, lead(t) OVER w AS until, lead(event_id) OVER w AS until_id FROM r WINDOW w AS (PARTITION BY layer_id, device_id ORDER BY t, event_id))"
_SINCE = "(h.t, h.event_id) < (r.t, r.event_id) AND (h.until IS NULL OR (h.until, h.until_id) >= (r.t, r.event_id))"


def _device_sql(op: str, shape: str | None, meters: float, every: bool, coarse: bool = False, other: tuple[str | None, float] = (None, 0.0)) -> str:
    wide = op in ("nintersects", "nnear")
    m = 50000.0 if wide else meters or 50.0
    y, x = f"{m} / {M}", f"{m} / {M} / cos(radians(r.lat))"
    near = f"abs(h.lat - r.lat) <= {y} AND abs(h.lon - r.lon) <= {x}" if every else f"h.device_id IN ({', '.join(repr(k) for k in _PEERS)})"
    cand = f"SELECT r.event_id, h.device_id AS other, r.lat, r.lon, h.lat AS lat2, h.lon AS lon2 FROM r JOIN h ON h.layer_id = r.layer_id AND h.device_id <> r.device_id AND {near} AND {_SINCE}"
    # Where one side is a place, all operators ask whether the other side holds it.
    test = _TEST[op] if shape and other[0] else "NOT meets" if op[0] == "n" and op != "near" else "meets"
    return f"WITH r AS ({tables.telemetry_sql(coarse=coarse)}), {_BEFORE}, {_pairs_sql(cand, _ring_sql(shape, meters, 'lat', 'lon'), _ring_sql(*other, 'lat2', 'lon2'))} {_REFS} FROM facts WHERE {test} GROUP BY event_id"


for _op in _TEST:
    for _name, (_shape, _m) in {"point": (None, 0.0), "bbox": ("bbox", 900.0), "radius": ("radius", 900.0)}.items():
        _all = _op in ("intersects", "near", "in") and _shape is not None
        _target = "devices(@)" if _all else f"devices({', '.join(_PEERS)})"
        _rule(f"{_op}_dev_{_name}", f"device{_area_text(_shape, _m)} {_op} {_target}", _device_sql(_op, _shape, _m, _all, coarse=_shape is None), coarse=_shape is None, columns=("event_id", "refs"))
    for _name, _mine, _other in (("radius_radius", ("radius", 2500.0), ("radius", 900.0)), ("bbox_bbox", ("bbox", 2500.0), ("bbox", 900.0)), ("point_radius", (None, 0.0), ("radius", 1500.0)), ("radius_bbox", ("radius", 2500.0), ("bbox", 900.0))):
        _rule(f"{_op}_dev_{_name}", f"device{_area_text(*_mine)} {_op} devices({', '.join(_PEERS)}){_area_text(*_other)}", _device_sql(_op, *_mine, False, other=_other), columns=("event_id", "refs"))


def _box_sql(at: str, of: str, meters: float) -> str:
    """``of`` lies in the box around ``at`` (aliases of readings)."""
    return f"abs({of}.lat - {at}.lat) <= {meters} / {M} AND abs({of}.lon - {at}.lon) <= {meters} / {M} / cos(radians({at}.lat))"


_SEEN = f"JOIN h ON h.layer_id = r.layer_id AND {_SINCE}"
_AND_OTHER = "h.device_id <> r.device_id"
_LIST = "SELECT r.event_id, string_agg(h.device_id, ',' ORDER BY h.device_id) AS refs"
for _op in ("nintersects", "nnear"):
    # All devices within 50 km are looked at.
    _rule(f"{_op}_dev_every", f"device :bbox 900m {_op} devices(@)", f"WITH r AS ({tables.telemetry_sql()}), {_BEFORE} SELECT r.event_id, count(*) AS n_refs FROM r {_SEEN} WHERE {_AND_OTHER} AND {_box_sql('r', 'h', 50000.0)} AND NOT ({_box_sql('r', 'h', 900.0)}) GROUP BY r.event_id", columns=("event_id", "n_refs"))
_rule("layer_devices", "device :bbox 900m NEAR devices(@) { :layer L3 }", f"WITH r AS ({tables.telemetry_sql(True)}), {_BEFORE} {_LIST} FROM r {_SEEN} WHERE r.layer_id = 'L3' AND {_AND_OTHER} AND {_box_sql('r', 'h', 900.0)} GROUP BY r.event_id", layers=True, columns=("event_id", "refs"))
_rule("own_position_compat", "device :bbox 900m NEAR devices(@)", f"WITH r AS ({tables.telemetry_sql()}), {_BEFORE} {_LIST} FROM r {_SEEN} WHERE {_box_sql('r', 'h', 900.0)} GROUP BY r.event_id", columns=("event_id", "refs"), compat=True)
_rule("every_and_named_dev", "device :bbox 900m NEAR devices(@, d3)", f"WITH r AS ({tables.telemetry_sql()}), {_BEFORE} {_LIST} FROM r {_SEEN} WHERE {_AND_OTHER} AND {_box_sql('r', 'h', 900.0)} GROUP BY r.event_id", columns=("event_id", "refs"))
_rule("set_vs_set", "devices(d3, d17) :bbox 4km INTERSECTS devices(d42, d8)", f"WITH r AS ({tables.telemetry_sql()}), {_BEFORE} {_LIST} FROM r {_SEEN} WHERE r.device_id IN ('d3', 'd17') AND h.device_id IN ('d42', 'd8') AND {_box_sql('r', 'h', 4000.0)} OR r.device_id IN ('d42', 'd8') AND h.device_id IN ('d3', 'd17') AND {_box_sql('h', 'r', 4000.0)} GROUP BY r.event_id", columns=("event_id", "refs"))

_HAV = "CAST(round(2 * 6371000.0 * asin(sqrt(least(1.0, power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin((radians({3}) - radians({1})) / 2), 2)))) / 50) * 50 AS BIGINT)"
for _op, _sign in _SIGNS.items():
    _d = _HAV.format("r.lat", "r.lon", "o.y", "o.x")
    _sql = f"WITH r AS ({tables.telemetry_sql()}), k AS ({tables.corners_sql()}), o AS (SELECT object_id AS other, (min(y) + max(y)) / 2 AS y, (min(x) + max(x)) / 2 AS x FROM k WHERE object_id IN ({', '.join(repr(k) for k in _SOME)}) GROUP BY object_id) {_REFS} FROM r CROSS JOIN o WHERE {_d} {_sign} 2000 GROUP BY event_id"
    _rule(f"dist_obj_{_op}", f"device :radius 2km {_op} objects({', '.join(_SOME)})", _sql, columns=("event_id", "refs"))
    _d = _HAV.format("r.lat", "r.lon", "h.lat", "h.lon")
    _sql = f"WITH r AS ({tables.telemetry_sql()}), {_BEFORE} SELECT r.event_id, string_agg(h.device_id, ',' ORDER BY h.device_id) AS refs FROM r JOIN h ON h.device_id IN ({', '.join(repr(k) for k in _PEERS)}) AND {_SINCE} WHERE {_d} {_sign} 3000 GROUP BY r.event_id"
    _rule(f"dist_dev_{_op}", f"device :radius 3km {_op} devices({', '.join(_PEERS)})", _sql, columns=("event_id", "refs"))


# -- firing policies ---------------------------------------------------------------------------


def _gate_sql(ok: str, passes: str, reset: int) -> str:
    """The fold as a recursion over the readings of each device in order."""
    again = f"({reset} = 0 OR s.last_reset IS NULL OR q.t - s.last_reset >= {reset})"
    seen, hits, start = f"(CASE WHEN {again} THEN NULL ELSE s.last_seen END)", f"(CASE WHEN {again} THEN 0 ELSE s.hits END)", f"(CASE WHEN {again} THEN q.t ELSE s.last_reset END)"
    test = passes.replace("SEEN", seen).replace("HITS", hits)
    return f"""WITH RECURSIVE r AS ({tables.telemetry_sql()}), q AS MATERIALIZED (SELECT device_id, event_id, t, {ok} AS ok, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS n FROM r),
    s AS (SELECT device_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS last_seen, CAST(NULL AS BIGINT) AS last_reset, 0 AS hits, false AS fires FROM (SELECT DISTINCT device_id FROM q)
      UNION ALL SELECT q.device_id, q.n, q.event_id, CASE WHEN q.ok AND ({test}) THEN q.t ELSE {seen} END, {start}, {hits} + CASE WHEN q.ok AND ({test}) THEN 1 ELSE 0 END, q.ok AND ({test})
      FROM s JOIN q ON q.device_id = s.device_id AND q.n = s.n + 1) SELECT event_id FROM s WHERE fires"""


_FAST = "CAST(trunc(speed) AS BIGINT) > 20"
_rule("trigger_once", "speed gt 20 { :trigger once :reset after 72h }", _gate_sql(_FAST, "HITS = 0", 259200))
_rule("trigger_every", "speed gt 20 { :trigger every 10h :reset after 240h }", _gate_sql(_FAST, "SEEN IS NULL OR q.t - SEEN >= 36000", 864000))
_rule("trigger_times", "speed gt 20 { :trigger 3 times interval 5h :reset after 120h }", _gate_sql(_FAST, "(SEEN IS NULL OR q.t - SEEN >= 18000) AND HITS < 3", 432000))
_rule("reset_after", "speed gt 20 { :trigger once }", _gate_sql(_FAST, "HITS = 0", 86400))
_rule("trigger_none", "speed gt 20 { :expire 10h }", f"WITH r AS ({tables.telemetry_sql()}) SELECT event_id FROM r WHERE {_FAST}")


# -- searches, stores, ingest ------------------------------------------------------------------


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_LAST = f"WITH r AS ({tables.telemetry_sql()}), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY layer_id, device_id ORDER BY ts DESC, event_id DESC) = 1)"


@query
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.latest(tables.telemetry(spark, sf_dir)).select("device_id", "event_id", "lat", "lon")


ORACLE["latest_position"] = f"{_LAST} SELECT device_id, event_id, lat, lon FROM l"


@query
def near_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices in the 2 km boxes around all suppliers' places."""
    k = F.col("s_suppkey")
    places = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("place_id"), (F.lit(42.90) + (k * 37 % 1000).cast("double") / F.lit(10000.0)).alias("place_lat"), (F.lit(-72.30) + (k * 91 % 1000).cast("double") / F.lit(10000.0)).alias("place_lon"))
    return stores.near_devices_of(places, stores.latest(tables.telemetry(spark, sf_dir)), 2000.0)


ORACLE["near_devices"] = f"""{_LAST}, p AS (SELECT s_suppkey AS place_id, CAST(42.90 AS DOUBLE) + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS y, CAST(-72.30 AS DOUBLE) + CAST(s_suppkey * 91 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS x FROM supplier)
  SELECT place_id, device_id FROM p JOIN l ON lat BETWEEN y - 2000 / {M} AND y + 2000 / {M} AND lon BETWEEN x - 2000 / {M} / cos(radians(y)) AND x + 2000 / {M} / cos(radians(y))"""


@query
def near_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.near_objects(tables.objects(spark, sf_dir), "", 42.9284, -72.2768, 1500.0).select("object_id")


ORACLE["near_objects"] = f"""WITH o AS ({tables.corners_sql()}) SELECT object_id FROM o GROUP BY object_id HAVING max(y) >= 42.9284 - 1500 / {M} AND min(y) <= 42.9284 + 1500 / {M}
  AND max(x) >= -72.2768 - 1500 / {M} / cos(radians(42.9284)) AND min(x) <= -72.2768 + 1500 / {M} / cos(radians(42.9284))"""


@query
def walk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the rules whose box holds them; one rule for the box of each object."""
    rules = tables.objects(spark, sf_dir, True).select(F.concat(F.lit("r"), F.col("object_id")).alias("rule_id"), "layer_id", "min_lat", "min_lon", "max_lat", "max_lon")
    return stores.walk_rules(tables.telemetry(spark, sf_dir, True), rules)


ORACLE["walk_rules"] = f"""WITH r AS ({tables.telemetry_sql(True)}), k AS ({tables.corners_sql(True)}), o AS (SELECT object_id, layer_id, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM k GROUP BY ALL)
  SELECT event_id, 'r' || object_id AS rule_id FROM r JOIN o ON o.layer_id = r.layer_id AND lat BETWEEN y1 AND y2 AND lon BETWEEN x1 AND x2"""


@query
def delete_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.delete(stores.latest(tables.telemetry(spark, sf_dir)), _PEERS, "device_id").select("device_id", "event_id")


ORACLE["delete_devices"] = f"{_LAST} SELECT device_id, event_id FROM l WHERE device_id NOT IN ({', '.join(repr(k) for k in _PEERS)})"


RULES = {
    "a": "device INTERSECTS polygon(@) AND speed RANGE [30 .. 120]",
    "b": 'model eq "error" OR battery lt 5',
    "c": f"device :radius 1km NEAR objects({', '.join(_SOME)}) AND (hour lt 6 OR hour gte 22)",
    "d": f"device :radius 2km lt devices({', '.join(_PEERS)})",
    "e": "temperature gt 45 { :trigger once :reset after 48h }",
}


@query
def detect_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, tables.objects(spark, sf_dir))
    for rule_id, text in RULES.items():
        engine.add_rule(text, rule_id)
    return engine.detect(tables.telemetry(spark, sf_dir)).select("event_id", F.col("rule.rule_id").alias("rule_id"))


ORACLE["detect_many_rules"] = f"""SELECT event_id, 'a' AS rule_id FROM ({_object_sql("intersects", None, 0.0, True)}) JOIN ({tables.telemetry_sql()}) USING (event_id) WHERE CAST(trunc(speed) AS BIGINT) BETWEEN 30 AND 120
  UNION ALL SELECT event_id, 'b' FROM ({tables.telemetry_sql()}) WHERE model = 'error' OR battery < 5
  UNION ALL SELECT event_id, 'c' FROM ({_object_sql("near", "radius", 1000.0, False)}) JOIN ({tables.telemetry_sql()}) USING (event_id) WHERE hour(ts) < 6 OR hour(ts) >= 22
  UNION ALL SELECT event_id, 'd' FROM (WITH r AS ({tables.telemetry_sql()}), {_BEFORE} SELECT DISTINCT r.event_id FROM r JOIN h ON h.device_id IN ({', '.join(repr(k) for k in _PEERS)}) AND {_SINCE} WHERE {_HAV.format("r.lat", "r.lon", "h.lat", "h.lon")} < 2000)
  UNION ALL SELECT event_id, 'e' FROM ({_gate_sql("CAST(trunc(temperature) AS BIGINT) > 45", "HITS = 0", 172800)})"""


@query
def cover_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.cover(tables.objects(spark, sf_dir), 0.01)


def _cover_sql() -> str:
    cell = "CAST(floor(CAST(0.01 AS DOUBLE) * 0 + {0} / CAST(0.01 AS DOUBLE)) AS BIGINT)"
    cand = f"""SELECT y.c * 100000 + x.c AS event_id, o.object_id AS other, y.c AS cy, x.c AS cx, o.ring FROM (SELECT object_id, list({{'y': y, 'x': x}} ORDER BY i) AS ring, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM o GROUP BY object_id) o,
      generate_series({cell.format("o.y1")}, {cell.format("o.y2")}) y(c), generate_series({cell.format("o.x1")}, {cell.format("o.x2")}) x(c)"""
    w = "CAST(0.01 AS DOUBLE)"
    square = f"[{{'y': cy * {w}, 'x': cx * {w}}}, {{'y': cy * {w}, 'x': cx * {w} + {w}}}, {{'y': cy * {w} + {w}, 'x': cx * {w} + {w}}}, {{'y': cy * {w} + {w}, 'x': cx * {w}}}, {{'y': cy * {w}, 'x': cx * {w}}}]"
    return f"WITH o AS ({tables.corners_sql()}), {_pairs_sql(cand, square, 'ring')}, cells AS (SELECT other AS object_id, '' AS layer_id, cy AS cell_y, cx AS cell_x FROM facts JOIN cand USING (event_id, other) WHERE meets)"


ORACLE["cover_cells"] = f"{_cover_sql()} SELECT * FROM cells"


@query
def cover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.index_counts(geojson.cover(tables.objects(spark, sf_dir), 0.01))


ORACLE["cover_counts"] = f"{_cover_sql()} SELECT object_id, count(*) AS n_cells FROM cells GROUP BY object_id"


@query
def cover_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.cells_by_host(geojson.cover(tables.objects(spark, sf_dir), 0.01), 5)


ORACLE["cover_by_host"] = f"{_cover_sql()} SELECT ((cell_y * 31 + cell_x) % 5 + 5) % 5 AS host, cell_y, cell_x, count(DISTINCT object_id) AS objects FROM cells GROUP BY ALL"


@query
def cover_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as FeatureCollections, read again."""
    found = geojson.cells_to_geojson(geojson.cover(tables.objects(spark, sf_dir), 0.01))
    kind, n = F.get_json_object("geojson", "$.type"), F.json_array_length(F.get_json_object("geojson", "$.features"))
    return found.select("object_id", kind.alias("kind"), n.cast("long").alias("n_features"), F.get_json_object("geojson", "$.features[0].geometry.type").alias("shape"))


ORACLE["cover_export"] = f"{_cover_sql()} SELECT object_id, 'FeatureCollection' AS kind, count(*) AS n_features, 'Polygon' AS shape FROM cells GROUP BY object_id"


@query
def geojson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written as GeoJSON and read again."""
    ring = F.transform(F.element_at("parts", 1)["edges"], lambda e: F.array(e["x1"], e["y1"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("coordinates"))
    rows = tables.objects(spark, sf_dir).select("object_id", "layer_id", F.to_json(shape).alias("geojson"))
    found = geojson.read_objects(rows)
    return found.select("object_id", "kind", F.size(F.element_at("parts", 1)["edges"]).alias("n_edges"), F.round(F.col("min_lat") * 1e6).cast("long").alias("min_lat"), F.round(F.col("max_lon") * 1e6).cast("long").alias("max_lon"))


ORACLE["geojson_parse"] = f"WITH o AS ({tables.corners_sql()}) SELECT object_id, 'polygon' AS kind, CAST(4 AS INTEGER) AS n_edges, CAST(round(min(y) * 1e6) AS BIGINT) AS min_lat, CAST(round(max(x) * 1e6) AS BIGINT) AS max_lon FROM o GROUP BY object_id"


# -- layers of targets, states, stores and rules ------------------------------------------------

_d = _HAV.format("r.lat", "r.lon", "h.lat", "h.lon")
_rule("dist_dev_layers", f"device :radius 3km lt devices({', '.join(_PEERS)}) {{ :layer L3 }}", f"WITH r AS ({tables.telemetry_sql(True)}), {_BEFORE} {_LIST} FROM r JOIN h ON {_SINCE} WHERE r.layer_id = 'L3' AND h.device_id IN ({', '.join(repr(k) for k in _PEERS)}) AND {_d} < 3000 GROUP BY r.event_id", layers=True, columns=("event_id", "refs"))

_TIMES = "speed gt 20 { :trigger 3 times interval 5h :reset after 120h }"
_LAST_STATE = _gate_sql(_FAST, "(SEEN IS NULL OR q.t - SEEN >= 18000) AND HITS < 3", 432000).replace("SELECT event_id FROM s WHERE fires", "SELECT device_id, CAST(hits AS INTEGER) AS hits, CAST(last_seen AS DOUBLE) AS last_seen, CAST(last_reset AS DOUBLE) AS last_reset FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY n DESC) = 1")


def _states(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    engine = Engine(spark, tables.objects(spark, sf_dir))
    engine.add_rule(_TIMES, "times")
    return engine, tables.telemetry(spark, sf_dir)


@query
def states_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of firing states."""
    engine, readings = _states(spark, sf_dir)
    return engine.states(readings).select("device_id", "hits", "last_seen", "last_reset")


ORACLE["states_after"] = _LAST_STATE


@query
def states_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states, from a snapshot half way that is taken up again."""
    engine, readings = _states(spark, sf_dir)
    early = F.dayofmonth("ts") <= 12
    return engine.states(readings.filter(~early), engine.states(readings.filter(early))).select("device_id", "hits", "last_seen", "last_reset")


ORACLE["states_restored"] = _LAST_STATE


@query
def states_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States without those of a device, and without one key."""
    engine, readings = _states(spark, sf_dir)
    kept = remove_states(remove_states(engine.states(readings), device_id="d3"), device_id="d17", rule_id="times")
    return remove_states(kept, device_id="d42", rule_id="other").select("device_id", "hits")


ORACLE["states_removed"] = f"SELECT device_id, hits FROM ({_LAST_STATE}) WHERE device_id NOT IN ('d3', 'd17')"


@query
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, readings = _states(spark, sf_dir)
    return lookup_state(engine.states(readings), "d3", "times").select("device_id", "hits", "last_reset")


ORACLE["state_lookup"] = f"SELECT device_id, hits, last_reset FROM ({_LAST_STATE}) WHERE device_id = 'd3'"


@query
def last_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each device was last in each object."""
    engine = Engine(spark, tables.objects(spark, sf_dir))
    engine.add_rule("device INTERSECTS polygon(@)", "inside")
    return visits(engine.detect(tables.telemetry(spark, sf_dir))).select("device_id", "object_id", "last_visit")


ORACLE["last_visits"] = f"SELECT device_id, object_id, max(t) AS last_visit FROM ({tables.telemetry_sql()}) JOIN (SELECT event_id, unnest(string_split(refs, ',')) AS object_id FROM ({_object_sql('intersects', None, 0.0, True)})) USING (event_id) GROUP BY ALL"


@query
def devices_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.lookup(stores.latest(tables.telemetry(spark, sf_dir)), "device_id", "d3").select("device_id", "event_id", "lat", "lon")


ORACLE["devices_lookup"] = f"{_LAST} SELECT device_id, event_id, lat, lon FROM l WHERE device_id = 'd3'"


@query
def devices_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices in one cell."""
    return stores.in_cells(stores.latest(tables.telemetry(spark, sf_dir)), 2146, -3614, 0.02).select("device_id")


ORACLE["devices_each"] = f"{_LAST} SELECT device_id FROM l WHERE floor(lat / 0.02::DOUBLE) = 2146 AND floor(lon / 0.02::DOUBLE) = -3614"


@query
def devices_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the first days, then all later readings."""
    readings = tables.telemetry(spark, sf_dir)
    early = F.dayofmonth("ts") <= 12
    return stores.upsert(stores.latest(readings.filter(early)), readings.filter(~early)).select("device_id", "event_id")


ORACLE["devices_upsert"] = f"{_LAST} SELECT device_id, event_id FROM l"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON texts of all kinds, some of them broken, one per nation."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    y, x = (k % 5).cast("double") + 40.0, F.floor(k / 5).cast("double") - 70.0
    at = lambda dx, dy: F.format_string("[%.3f,%.3f]", x + dx, y + dy)
    line = F.concat(F.lit("["), at(0.0, 0.0), F.lit(","), at(0.25, 0.5), F.lit("]"))
    ring = F.concat(F.lit("["), at(0.0, 0.0), F.lit(","), at(0.25, 0.0), F.lit(","), at(0.25, 0.5), F.lit(","), at(0.0, 0.0), F.lit("]"))
    one = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), *coordinates, F.lit("}"))
    point = one("Point", [at(0.0, 0.0)])
    texts = [
        point, one("MultiPoint", [line]), one("LineString", [line]), one("MultiLineString", [F.lit("["), line, F.lit("]")]), one("Polygon", [F.lit("["), ring, F.lit("]")]), one("MultiPolygon", [F.lit("[["), ring, F.lit("]]")]),
        F.concat(F.lit('{"type":"GeometryCollection","geometries":['), point, F.lit(","), one("LineString", [line]), F.lit("]}")),
        F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), point, F.lit("}")),
        F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), one("LineString", [line]), F.lit("}]}")),
        one("Polygon", [F.lit("["), line, F.lit("]")]), F.lit('{"type":"Circle"}'), F.lit("no json"), F.lit(None).cast("string"),
    ]
    chosen = F.lit(None).cast("string")
    for n, t in enumerate(texts):
        chosen = F.when(k % len(texts) == n, t).otherwise(chosen)
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), k.cast("string")).alias("object_id"), name.alias("layer_id"), chosen.alias("geojson"))


_KINDS = "(VALUES (0, 'point', 1, 0.0), (1, 'multiPoint', 2, 0.5), (2, 'line', 1, 0.5), (3, 'multiLine', 1, 0.5), (4, 'polygon', 1, 0.5), (5, 'multiPolygon', 1, 0.5), (6, 'collection', 2, 0.5), (7, 'feature', 1, 0.0), (8, 'featureCollection', 1, 0.5)) AS k(i, kind, n_parts, high)"


@query
def geojson_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geojson.read_objects(_shapes(spark, sf_dir))
    return found.select("object_id", "layer_id", "kind", F.size("parts").alias("n_parts"), "min_lat", "max_lat", F.size(boundary()).alias("n_edges"))


ORACLE["geojson_kinds"] = f"SELECT 'n' || n_nationkey AS object_id, n_name AS layer_id, kind, n_parts, 40.0::DOUBLE + n_nationkey % 5 AS min_lat, 40.0::DOUBLE + n_nationkey % 5 + high::DOUBLE AS max_lat, CASE kind WHEN 'multiPoint' THEN 2 WHEN 'polygon' THEN 3 WHEN 'multiPolygon' THEN 3 WHEN 'collection' THEN 2 ELSE 1 END AS n_edges FROM nation JOIN {_KINDS} ON i = n_nationkey % 13"


@query
def geojson_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.invalid(_shapes(spark, sf_dir)).select("object_id")


ORACLE["geojson_invalid"] = "SELECT 'n' || n_nationkey AS object_id FROM nation WHERE n_nationkey % 13 >= 9"


@query
def objects_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects added twice, some deleted, and those of one cell."""
    engine = Engine(spark)
    engine.add_objects(_shapes(spark, sf_dir))
    engine.add_objects(_shapes(spark, sf_dir).withColumn("layer_id", F.lit("second")))
    engine.delete_objects(["n1", "n14"])
    in_cell = stores.in_cells(engine.objects, 20, -35, 2.0).select("object_id", F.lit("each").alias("how"), "layer_id")
    found = stores.lookup(engine.objects, "object_id", "n2").select("object_id", F.lit("lookup").alias("how"), "layer_id")
    return engine.objects.select("object_id", F.lit("all").alias("how"), "layer_id").unionByName(in_cell).unionByName(found)


ORACLE["objects_store"] = """WITH o AS (SELECT 'n' || n_nationkey AS object_id, n_name AS layer_id, n_nationkey AS k FROM nation WHERE n_nationkey % 13 < 9 AND n_nationkey NOT IN (1, 14))
  SELECT object_id, 'all' AS how, layer_id FROM o UNION ALL SELECT object_id, 'lookup', layer_id FROM o WHERE k = 2
  UNION ALL SELECT object_id, 'each', layer_id FROM o WHERE k % 5 < 2 AND k // 5 BETWEEN 0 AND 1"""


@query
def object_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object against the 1.5 km boxes around all suppliers' places."""
    k = F.col("s_suppkey")
    places = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("place_id"), (F.lit(42.90) + (k * 37 % 1000).cast("double") / F.lit(10000.0)).alias("lat"), (F.lit(-72.30) + (k * 91 % 1000).cast("double") / F.lit(10000.0)).alias("lon"), F.lit("").alias("layer_id"))
    pairs = places.join(tables.objects(spark, sf_dir).select("layer_id", "object_id", "parts"), "layer_id")
    return relations(pairs, "bbox", 1500.0).select("place_id", "object_id", "intersects", "within", "contains")


def _relations_sql() -> str:
    places = "SELECT s_suppkey AS event_id, CAST(42.90 AS DOUBLE) + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat, CAST(-72.30 AS DOUBLE) + CAST(s_suppkey * 91 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon FROM supplier"
    cand = f"SELECT event_id, object_id AS other, lat, lon, ring FROM ({places}) p, (SELECT object_id, list({{'y': y, 'x': x}} ORDER BY i) AS ring FROM o GROUP BY object_id) o"
    inside = "list_bool_and(list_transform(range(1, len(ring)), lambda i: (ring[i + 1].x - ring[i].x) * (lat - ring[i].y) - (ring[i + 1].y - ring[i].y) * (lon - ring[i].x) >= 0)) OR list_bool_and(list_transform(range(1, len(ring)), lambda i: (ring[i + 1].x - ring[i].x) * (lat - ring[i].y) - (ring[i + 1].y - ring[i].y) * (lon - ring[i].x) <= 0))"
    return f"WITH o AS ({tables.corners_sql()}), {_pairs_sql(cand, _ring_sql('bbox', 1500.0, 'lat', 'lon'), 'ring')} SELECT event_id AS place_id, other AS object_id, meets AS intersects, within, ({inside}) AS contains FROM facts JOIN cand USING (event_id, other)"


ORACLE["object_relations"] = _relations_sql()


@query
def rules_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a table: centre and box from the objects they name, restored from their own snapshot, one deleted."""
    engine = Engine(spark, tables.objects(spark, sf_dir))
    for k in range(6):
        engine.add_rule(f"device :radius 500m INTERSECTS polygon(n{k}, n{k + 7}) AND speed gt {k}", f"r{k}")
    again = Engine(spark, tables.objects(spark, sf_dir))
    again.restore_rules(engine.rules)
    again.delete_rule("r2")
    e6 = lambda c: F.round(F.col(c) * 1e6).cast("long").alias(c)
    return again.rules.select("rule_id", "spec", e6("center_lat"), e6("center_lon"), F.array_join("refs", ",").alias("refs"), (F.col("max_lat") > F.col("center_lat")).alias("has_box"))


ORACLE["rules_store"] = f"""WITH o AS ({tables.corners_sql()}), k AS (SELECT unnest([0, 1, 3, 4, 5]) AS k),
  c AS (SELECT k, (min(y) + max(y)) / 2 AS y, (min(x) + max(x)) / 2 AS x FROM k JOIN o ON object_id IN ('n' || k, 'n' || (k + 7)) GROUP BY k)
  SELECT 'r' || k AS rule_id, 'device :radius 500m INTERSECTS polygon(n' || k || ', n' || (k + 7) || ') AND speed gt ' || k AS spec, CAST(round(y * 1e6) AS BIGINT) AS center_lat, CAST(round(x * 1e6) AS BIGINT) AS center_lon, 'n' || k || ',n' || (k + 7) AS refs, true AS has_box FROM c"""


@query
def rule_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius that grows until it holds a rule's objects, and cells of the rule's area."""
    engine = Engine(spark, tables.objects(spark, sf_dir))
    engine.add_rule("device IN polygon(n0, n24)", "far")
    engine.add_rule("speed gt 5 { :center 42.95 -72.25 :radius 2km }", "round")
    return spark.createDataFrame([("reach", engine.reach("far", (42.95, -72.25), 500.0))], "what string, value double").unionByName(engine.region_ids("round", 0.01).agg(F.lit("cells").alias("what"), F.count("*").cast("double").alias("value")))


ORACLE["rule_reach"] = f"""WITH o AS ({tables.corners_sql()}), b AS (SELECT min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM o WHERE object_id IN ('n0', 'n24')),
  r AS (SELECT 500.0 * power(3, i) AS m FROM range(11) t(i)),
  h AS (SELECT 2000 / {M} AS y, 2000 / {M} / cos(radians(42.95)) AS x)
  SELECT 'reach' AS what, CAST(min(m) AS DOUBLE) AS value FROM r, b WHERE 42.95 - m / {M} <= y1 AND 42.95 + m / {M} >= y2 AND -72.25 - m / {M} / cos(radians(42.95)) <= x1 AND -72.25 + m / {M} / cos(radians(42.95)) >= x2
  UNION ALL SELECT 'cells', CAST((floor((42.95 + y) / 0.01::DOUBLE) - floor((42.95 - y) / 0.01::DOUBLE) + 1) * (floor((-72.25 + x) / 0.01::DOUBLE) - floor((-72.25 - x) / 0.01::DOUBLE) + 1) AS DOUBLE) FROM h"""


@query
def clamped_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", clamped(F.col("s_acctbal") * 10).alias("meters"))


ORACLE["clamped_distance"] = "SELECT s_suppkey, least(greatest(coalesce(s_acctbal * 10, 50), 50), 50000) AS meters FROM supplier"

#: Texts that are no rules, and one that is.
WRONG = (
    "speed eq \"fast\"", "model lt 5", "speed in [1 .. 2]", "speed range [1, 2]", "time in [10:00, 11:00]", "model range [\"a\" .. \"b\"]", "speed range [5 .. 1]", "datetime lt \"2024-01-01T00:00:00\"",
    "devices(@) IN polygon(@)", "devices(@) NEAR devices(@)", "device IN device", "polygon(a) IN polygon(b)", "device :radius 1km lt devices(@)", "device lt objects(a)", "speed eq 1 AND", "speed eq 1",
)


@query
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(text: str) -> str:
        try:
            compile_rule(text)
        except TypeErrorInRule:
            return "types"
        except ParseError:
            return "text"
        return "none"

    return spark.createDataFrame([(t, kind(t)) for t in WRONG], "spec string, error string")


ORACLE["rule_errors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{'none' if t == 'speed eq 1' else 'text' if t.endswith('AND') else 'types'}')" for t in WRONG) + ") AS t(spec, error)"


def _globe(k: Column) -> list[Column]:
    """A place on the globe for a number, spread evenly."""
    return [F.degrees(F.asin((k * 7919 % 100003).cast("double") / F.lit(50001.5) - F.lit(1.0))), (k * 104729 % 100019).cast("double") / F.lit(100019.0) * F.lit(360.0) - F.lit(180.0)]


@query
def nearby_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place on the globe for each event; how many of them lie within the 10 km box of each."""
    y, x = _globe(F.col("event_id"))
    at = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", y.alias("lat"), x.alias("lon"))
    return stores.near_counts_of(at.select(F.col("event_id").alias("place_id"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon")), at.withColumnRenamed("event_id", "device_id"), 10_000.0)


ORACLE["nearby_search"] = f"""WITH p AS (SELECT event_id AS k, degrees(asin(CAST(event_id * 7919 % 100003 AS DOUBLE) / 50001.5 - 1)) AS y, CAST(event_id * 104729 % 100019 AS DOUBLE) / 100019.0 * 360 - 180 AS x FROM events)
  SELECT a.k AS place_id, count(*) AS n FROM p a JOIN p b ON b.y BETWEEN a.y - 10000 / {M} AND a.y + 10000 / {M} AND least(abs(a.x - b.x), 360 - abs(a.x - b.x)) <= 10000 / {M} / greatest(cos(radians(a.y)), 1e-6) GROUP BY a.k"""
