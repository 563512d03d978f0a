import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from geowarden.engine import Engine
from geowarden.functions.geo import haversine
from geowarden.lang.ast import Trigger
from geowarden.operators import stores
from geowarden.operators.gate import State, gate, step
from geowarden.sources.geojson import cells_to_geojson, cover, invalid, read_objects

D, G, O, P = "van1", "bike3", "van2", "yard"
RING = [(-72.2800060, 42.9238589), (-72.2802743, 42.9231989), (-72.2790616, 42.9232461), (-72.2787397, 42.9239689), (-72.2799953, 42.9238746), (-72.2800060, 42.9238589)]
T0 = datetime(2024, 1, 5, 12, 0, 0)
SCHEMA = "event_id long, device_id string, ts timestamp, lat double, lon double, speed double, layer_id string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def polygon(spark):
    return spark.createDataFrame([(P, "", json.dumps({"type": "Polygon", "coordinates": [RING]}))], "object_id string, layer_id string, geojson string")


def run(spark, text, target, stored, objects=None, layer=""):
    engine = Engine(spark)
    if objects is not None:
        engine.add_objects(objects)
    engine.add_rule(text, "r")
    rows = [(k, d, at(k), y, x, 0.0, "") for k, (d, y, x) in enumerate(stored)]
    history = spark.createDataFrame(rows, SCHEMA)
    reading = spark.createDataFrame([(100, D, at(100), *target, 0.0, layer)], SCHEMA)
    return [r.match for r in engine.detect(reading, history).collect()]


FAR = ((42.9246289, -72.2876353), [(O, 42.9152319, -72.2498989)])
CLOSE = ((42.9214863, -72.2759164), [(O, 42.9236704, -72.2768608)])
NEAR = ((42.9214863, -72.2794802), [(O, 42.9240239, -72.2787075), (G, 42.9226333, -72.2732452)])


@pytest.mark.parametrize(("text", "case", "refs"), [
    ("device :radius 1km IN devices(@) :radius 100m", ((42.9236468, -72.2793728), [(O, 42.9229004, -72.2791582)]), [O]),
    ("device :bbox 1km IN devices(@)", ((42.9236468, -72.2793728), [(O, 42.9229004, -72.2791582)]), [O]),
    (f"devices({D}) :radius 2km IN devices({O})", ((42.9236468, -72.2793728), [(O, 42.9229004, -72.2791582)]), [O]),
    (f"devices({D}) NINTERSECTS devices(@)", FAR, [O]),
    (f"device :radius 500m NINTERSECTS devices({O}) :bbox 1km", FAR, [O]),
    ("devices(@) :radius 1km INTERSECTS devices(" + D + ") :radius 1km", CLOSE, [O]),
    (f"devices({D}) INTERSECTS devices({O})", ((42.9214863, -72.2759164), [(O, 42.9214863, -72.2759164)]), [O]),
    (f"devices({D}) :radius 500m NEAR devices(@)", NEAR, [O]),
    (f"devices({D}) :bbox 500m NEAR devices(@) :bbox 10m", NEAR, [O]),
    (f"device :radius 350m gt devices({O}, {G})", NEAR, [G]),
    (f"device :radius 500m lte devices({O}, {G})", NEAR, [G, O]),
    ("device NEAR devices(@)", ((42.9, -72.2), [(O, 42.9, -72.2), (G, 42.9, -72.2)]), [G, O]),
])
def test_device_vectors(spark, text, case, refs):
    got = run(spark, text, *case)
    assert len(got) == 1 and got[0][0].ok and sorted(got[0][0].right.refs) == sorted(refs)


@pytest.mark.parametrize("text", [f"devices({D}) INTERSECTS polygon({P})", f"devices({D}) :radius 1km INTERSECTS polygon(@)", f"polygon({P}) INTERSECTS devices({D})", f"device IN polygon({P})", f"device :radius 1km IN polygon({P})", f"device :bbox 500m NEAR polygon(@)"])
def test_object_vectors(spark, polygon, text):
    got = run(spark, text, (42.9236075, -72.2792333), [], polygon)
    assert len(got) == 1 and got[0][0].right.refs == [P] and got[0][0].right.keyword == "polygon"


def test_no_match_in_another_layer_or_outside(spark, polygon):
    assert not run(spark, f"devices({D}) INTERSECTS devices({O}) {{ :layer other }}", *CLOSE)
    assert not run(spark, f"device INTERSECTS polygon({P})", (42.93, -72.28), [], polygon)
    assert run(spark, "device :radius 100m NINTERSECTS polygon(@)", (42.9236075, -72.2792333 + 0.0009), [], polygon) == []


def test_haversine_agrees(spark):
    want = 254.7
    got = spark.range(1).select(haversine(F.lit(42.9214863), F.lit(-72.2759164), F.lit(42.9236704), F.lit(-72.2768608))).first()[0]
    assert abs(got - want) < 0.1


def test_boolean_tables(spark):
    rows = [(k, "d", at(k), 0.0, 0.0, float(k), "") for k in range(8)]
    readings = spark.createDataFrame(rows, SCHEMA)
    bit = lambda b: f"speed in [{', '.join(str(k) for k in range(8) if k >> b & 1)}]"
    a, b, c = bit(0), bit(1), bit(2)
    for text, f in ((f"{a} and {b} or {c}", lambda x, y, z: x and y or z), (f"{a} or {b} and {c}", lambda x, y, z: x or y and z), (f"({a} or {b}) and {c}", lambda x, y, z: (x or y) and z), (f"{a} and {b} and {c}", lambda x, y, z: x and y and z)):
        engine = Engine(spark)
        engine.add_rule(text)
        assert {r.event_id for r in engine.detect(readings).collect()} == {k for k in range(8) if f(k & 1, k & 2, k & 4)}, text


def test_gate_is_the_fold(spark):
    rng = random.Random(11)
    policies = {"once": (Trigger("once"), 600.0), "every": (Trigger("every", 0, 90.0), 86400.0), "times": (Trigger("times", 3, 60.0), 1000.0), "zero": (Trigger("once"), 0.0)}
    rows = [(k, f"d{rng.randrange(4)}", rule, rng.random() < 0.6, float(rng.randrange(5000))) for k in range(300) for rule in policies]
    df = spark.createDataFrame(rows, "event_id long, device_id string, rule_id string, ok boolean, now double")
    for compat in (False, True):
        want, by = set(), defaultdict(list)
        for r in rows:
            by[r[1], r[2]].append(r)
        for (_, rule), mine in by.items():
            state = State()
            for r in sorted(mine, key=lambda r: (r[4], r[0])):
                if step(state, r[4], r[3], *policies[rule], compat):
                    want.add((r[0], rule))
        assert {(r.event_id, r.rule_id) for r in gate(df, policies, compat).collect()} == want


def test_trigger_once_and_reset(spark):
    readings = spark.createDataFrame([(k, "d", at(k), 0.0, 0.0, 1.0, "") for k in range(300)], SCHEMA)
    engine = Engine(spark)
    engine.add_rule("speed eq 1 { :trigger once :reset after 5m0s }", "a")
    engine.add_rule("speed eq 1 { :trigger every 10m }", "b")
    engine.add_rule("speed eq 1 { :trigger 4 times interval 2m }", "c")
    counts = {r["rule_id"]: r["count"] for r in engine.detect(readings).groupBy("rule.rule_id").count().collect()}
    assert counts == {"a": 60, "b": 30, "c": 4}


def test_stores_and_searches(spark, polygon):
    rows = [(1, "a", at(1), 42.93129, -72.28453, 0.0, ""), (2, "a", at(2), 42.93165, -72.28415, 0.0, ""), (3, "b", at(1), 43.5, -72.2, 0.0, "")]
    devices = stores.latest(spark.createDataFrame(rows, SCHEMA))
    assert {(r.device_id, r.event_id) for r in devices.collect()} == {("a", 2), ("b", 3)}
    assert [r.device_id for r in stores.near_devices(devices, 42.9316717, -72.2846072, 1e9).collect()] == ["a"]
    assert stores.delete(devices, ["a"], "device_id").count() == 1
    objects = read_objects(polygon)
    assert stores.add(objects, objects, "object_id").count() == 1 and stores.near_objects(objects, "", 42.9283436, -72.2757292, 400.0).count() == 0
    assert stores.near_objects(objects, "", 42.9240, -72.2795, 0.0).count() == 1
    places = spark.createDataFrame([(1, 42.9316717, -72.2846072)], "place_id int, place_lat double, place_lon double")
    assert stores.near_devices_of(places, devices, 200.0).count() == 1


def test_rules_table_round_trip(spark, polygon):
    engine = Engine(spark)
    engine.add_objects(polygon)
    engine.add_rule(f'device :radius 1km INTERSECTS polygon({P}) AND model eq "x" {{ :trigger every 10s :expire 10h }}', "r1")
    engine.add_rule("speed gt 1 { :center 42.5 -72.5 :radius 3km }", "r2")
    again = Engine(spark, engine.objects)
    again.restore_rules(engine.rules)
    assert again.rules.collect() == engine.rules.collect() and engine.rule("r2").box[0] < 42.5 < engine.rule("r2").box[2]
    rows = [(1, "a", at(1), 42.5, -72.5, 0.0, ""), (2, "a", at(1), 45.0, -72.5, 0.0, "")]
    assert [tuple(r) for r in stores.walk_rules(spark.createDataFrame(rows, SCHEMA), engine.rules.filter("rule_id = 'r2'")).collect()] == [(1, "r2")]
    engine.delete_rule("r1")
    assert engine.rules.count() == 1


def test_hooks(spark):
    seen = []
    engine = Engine(spark, before=lambda rule: (rule == "a") & (F.col("speed") > 2), after=seen.append)
    engine.add_rule("speed gt 0", "a")
    readings = spark.createDataFrame([(k, "d", at(k), 0.0, 0.0, float(k), "") for k in range(5)], SCHEMA)
    assert {r.event_id for r in engine.detect(readings).collect()} == {1, 2} and len(seen) == 1


def test_geojson_kinds_and_cover(spark):
    square = [[[100.0, 0.0], [101.0, 0.0], [101.0, 1.0], [100.0, 1.0], [100.0, 0.0]]]
    hole = [[100.4, 0.4], [100.6, 0.4], [100.6, 0.6], [100.4, 0.6], [100.4, 0.4]]
    shapes = {
        "point": {"type": "Point", "coordinates": [100.5, 0.5]}, "multi": {"type": "MultiPoint", "coordinates": [[0.0, 0.0], [1.0, 1.0]]},
        "line": {"type": "LineString", "coordinates": [[100.0, 0.0], [101.0, 1.0]]}, "lines": {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]]},
        "polygon": {"type": "Polygon", "coordinates": square}, "holed": {"type": "Polygon", "coordinates": [*square, hole]}, "polygons": {"type": "MultiPolygon", "coordinates": [square]},
        "all": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": square}, {"type": "Point", "coordinates": [5.0, 5.0]}]}}]},
    }
    rows = [(k, "", json.dumps(v)) for k, v in shapes.items()] + [("bad", "", "{"), ("open", "", json.dumps({"type": "Polygon", "coordinates": [square[0][:-1]]})), (None, "", json.dumps(shapes["point"])), ("none", None, None)]
    df = spark.createDataFrame(rows, "object_id string, layer_id string, geojson string")
    objects = read_objects(df)
    got = {r.object_id: r for r in objects.collect()}
    assert set(got) == set(shapes) and len(got["all"].parts) == 2 and invalid(df).count() == 4
    assert (got["polygon"].min_lat, got["polygon"].max_lon, got["polygon"].center_lat) == (0.0, 101.0, 0.5)
    cells = cover(objects, 0.25).groupBy("object_id").count()
    n = {r["object_id"]: r["count"] for r in cells.collect()}
    assert n["polygon"] == 25 and n["holed"] == 25 and n["point"] == 1 and n["line"] == 13 and n["multi"] == 5
    assert len(json.loads(cells_to_geojson(cover(objects, 0.25).filter("object_id = 'polygon'"), 0.25).first().geojson)["features"]) == 25
    engine = Engine(spark, objects)
    engine.add_rule("device IN polygon(holed)", "in")
    engine.add_rule("device :radius 10km NEAR line(line)", "near")
    readings = spark.createDataFrame([(1, "d", at(1), 0.5, 100.5, 0.0, ""), (2, "d", at(2), 0.2, 100.3, 0.0, ""), (3, "d", at(3), 0.0, 100.0, 0.0, "")], SCHEMA)
    assert {(r.event_id, r.rule.rule_id) for r in engine.detect(readings).collect()} == {(2, "in"), (3, "in"), (1, "near"), (2, "near"), (3, "near")}


def test_last_position_before_the_reading(spark):
    rows = [(1, "a", at(0), 10.0, 10.0, 0.0, ""), (2, "b", at(1), 10.0, 10.0, 0.0, ""), (3, "b", at(2), 20.0, 20.0, 0.0, ""), (4, "a", at(3), 10.0, 10.0, 0.0, ""), (5, "a", at(3), 20.0, 20.0, 0.0, ""), (6, "a", at(60 * 24 * 9), 20.0, 20.0, 0.0, "")]
    engine = Engine(spark)
    engine.add_rule("device :radius 10m NEAR devices(@)", "all")
    engine.add_rule("device :radius 10m NEAR devices(b)", "ids")
    got = {(r.event_id, r.rule.rule_id) for r in engine.detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, "all"), (5, "all"), (5, "ids"), (6, "all"), (6, "ids")}


def test_calendar_words(spark):
    t = datetime(2021, 1, 3, 23, 30, 59, tzinfo=timezone.utc)
    readings = spark.createDataFrame([(1, "d", t, 0.0, 0.0, -10.9, "")], SCHEMA)
    yes = ["week eq 53", "month eq \"January\"", "day eq \"Sunday\"", "day eq 3", "hour eq 23", "date eq \"2021-01-03\"", "time gt 23:30", "time lt 23:31", "time range [23:00 .. 23:31]", "year in [2020, 2021]", "speed eq -10", "speed lt -10.5", "date range [\"2021-01-03\" .. \"2021-01-04\"]", "datetime lt \"2021-01-04T00:31:00+01:00\"", "speed nrange [-10 .. 5]", "owner eq \"\"", "battery eq 0"]
    no = ["speed range [-9 .. 5]", "date range [\"2021-01-02\" .. \"2021-01-03\"]", "time range [00:00 .. 12:00]", "month nin [\"January\"]", "speed gt -10", "datetime eq \"2021-01-03T23:30:58+00:00\""]
    engine = Engine(spark)
    for k, text in enumerate(yes + no):
        engine.add_rule(text, str(k))
    assert {int(r.rule.rule_id) for r in engine.detect(readings).collect()} == set(range(len(yes)))


def test_across_the_antimeridian(spark):
    """Two devices 200 m apart on either side of 180 degrees, and an object beside it."""
    stored = [(O, -17.0, 179.9991)]
    for text in ("device :radius 5km NEAR devices(@)", f"device :radius 5km NEAR devices({O})", "device :bbox 5km INTERSECTS devices(@)"):
        assert [m[0].right.refs for m in run(spark, text, (-17.0, -179.9990), stored)] == [[O]], text
    ring = [(179.99, -17.01), (179.999, -17.01), (179.999, -16.99), (179.99, -16.99), (179.99, -17.01)]
    objects = spark.createDataFrame([(P, "", json.dumps({"type": "Polygon", "coordinates": [ring]}))], "object_id string, layer_id string, geojson string")
    assert [m[0].right.refs for m in run(spark, "device :radius 1km NEAR polygon(@)", (-17.0, -179.999), [], objects)] == [[P]]
    assert run(spark, "device :radius 100m NEAR polygon(@)", (-17.0, -179.99), [], objects) == []
    places = spark.createDataFrame([(1, -17.0, -179.999)], "place_id int, place_lat double, place_lon double")
    devices = spark.createDataFrame([("a", -17.0, 179.9991), ("b", -17.0, 179.0)], "device_id string, lat double, lon double")
    assert [r.device_id for r in stores.near_devices_of(places, devices, 1000.0).collect()] == ["a"]
    assert [r.device_id for r in stores.near_devices(devices, -17.0, -179.999, 1000.0).collect()] == ["a"]


def test_intervals_of_any_length(spark):
    """Positions that hold for seconds, hours and years, against the definition; a silent device is filed once."""
    from geowarden.operators.candidates import BLOCKS_S, _blocks, intervals, near_devices
    from geowarden.plans.detect import normalise

    rng = random.Random(21)
    rows = []
    for k in range(400):
        moment = T0 + timedelta(seconds=round(10 ** rng.uniform(0, 8.2)))
        rows.append((k, f"d{rng.randrange(12)}", moment, 42.9 + rng.random() * 0.02, -72.3 + rng.random() * 0.02, 0.0, ""))
    readings = normalise(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.event_id, r.other_id, r.other_lat) for r in near_devices(readings, readings, 900.0, True, ()).collect())
    want = []
    for e, d, t, y, x, _, _ in rows:
        last = {}
        for e2, d2, t2, y2, x2, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            if d2 != d and (t2, e2) < (t, e):
                last[d2] = (y2, x2)
        high = 900.0 / 111194.92664455873
        from math import cos, radians
        want += [(e, k, y2) for k, (y2, x2) in last.items() if abs(y2 - y) <= high and abs(x2 - x) <= high / cos(radians(y))]
    assert got == sorted(want)
    filed = _blocks(intervals(readings)).groupBy("event_id", "until").count().collect()
    assert max(r["count"] for r in filed if r.until is None) == 1 and max(r["count"] for r in filed) <= 18 and len(BLOCKS_S) == 6


def test_large_boxes_have_few_cells(spark):
    from geowarden.operators.candidates import over_levels

    boxes = spark.createDataFrame([(1, 0.0, 0.0, 60.0, 60.0), (2, 0.0, 0.0, 0.3, 0.3), (3, -90.0, -180.0, 90.0, 180.0)], "id int, a double, b double, c double, d double")
    rows = over_levels(boxes, 0.1, F.col("a"), F.col("b"), F.col("c"), F.col("d")).groupBy("id").count().collect()
    assert {r["id"] for r in rows} == {1, 2, 3} and max(r["count"] for r in rows) <= 100


def test_readings_without_a_time_are_set_apart(spark):
    from geowarden.plans.detect import untimed

    rows = [(1, D, None, 42.9, -72.3, 50.0, ""), (2, D, at(1), 42.9, -72.3, 50.0, ""), (3, D, None, 42.9, -72.3, 50.0, ""), (4, D, at(2), 42.9, -72.3, 50.0, "")]
    readings = spark.createDataFrame(rows, SCHEMA)
    engine = Engine(spark)
    engine.add_rule("speed gt 20 { :trigger once }", "r")
    assert [r.event_id for r in engine.detect(readings).collect()] == [2]
    assert sorted(r.event_id for r in untimed(readings).collect()) == [1, 3]


def test_hook_after_and_nested_brackets(spark, polygon):
    seen = []
    engine = Engine(spark, after=lambda df: seen.append(df.count()))
    engine.add_rule("(" * 900 + "speed gt 20" + ")" * 900, "deep")
    engine.detect(spark.createDataFrame([(1, D, at(1), 42.9, -72.3, 50.0, "")], SCHEMA)).collect()
    assert seen == [1]


def test_rules_that_share_a_leaf_share_its_join(spark, polygon):
    """Forty rules over two spatial leaves: matches are those of each rule alone, with its own labels."""
    inside = (42.9236075, -72.2792333)
    rows = [(k, f"v{k % 3}", at(k), inside[0] + 0.002 * (k % 4), inside[1], float(k % 50), "") for k in range(60)]
    readings = spark.createDataFrame(rows, SCHEMA)
    engine = Engine(spark)
    engine.add_objects(polygon)
    texts = {f"r{k}": (f"speed gt {k} AND device INTERSECTS polygon(@)" if k % 2 else f"line(@) NEAR device :radius 150m AND speed lt {k}") for k in range(40)}
    for rule_id, text in texts.items():
        engine.add_rule(text, rule_id)
    found = engine.detect(readings)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") < 12
    got = {(r.rule.rule_id, r.event_id): [(m.operator, m.right.keyword) for m in r.match] for r in found.collect()}
    for k in (0, 1, 10, 11, 38, 39):
        alone = Engine(spark)
        alone.add_objects(polygon)
        alone.add_rule(texts[f"r{k}"], f"r{k}")
        want = {(r.rule.rule_id, r.event_id): [(m.operator, m.right.keyword) for m in r.match] for r in alone.detect(readings).collect()}
        assert {x: v for x, v in got.items() if x[0] == f"r{k}"} == want
    assert got
