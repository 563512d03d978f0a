import random
from collections import defaultdict
from datetime import datetime, timedelta
from math import cos, radians

import pytest
from pyspark.sql import functions as F

from geowarden.engine import Engine
from geowarden.functions import geo
from geowarden.lang.check import compile_rule
from geowarden.operators import stores, sweep
from geowarden.plans.detect import device_hits, normalise

SCHEMA = "event_id long, device_id string, ts timestamp, lat double, lon double, speed double, layer_id string"
T0 = datetime(2024, 1, 5, 12, 0, 0)


def places(seed, n, devices, lat, lon, spread, layers=1):
    rng = random.Random(seed)
    turn = lambda x: (x + 180) % 360 - 180
    return [(k, f"d{rng.randrange(devices)}", T0 + timedelta(seconds=rng.randrange(n // 2)), lat + rng.random() * spread, turn(lon + rng.random() * spread), 0.0, f"L{rng.randrange(layers)}" if layers > 1 else "") for k in range(n)]


def seen(rows, same=False):
    """By definition: (reading, device, its last position) of the same layer."""
    last, out = defaultdict(dict), []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out += [(r, d, *p) for d, p in last[r[6]].items() if same or d != r[1]]
        last[r[6]][r[1]] = (r[3], r[4])
    return out


@pytest.fixture
def cut(monkeypatch):
    """Many slabs on few readings."""
    monkeypatch.setattr(sweep, "LEAST", (100, 50))


@pytest.mark.parametrize(("text", "lat", "lon"), [
    ("device :bbox 900m NEAR devices(@)", 42.9, -72.3),
    ("device :radius 900m IN devices(@)", 42.9, -72.3),
    ("device :radius 2km NINTERSECTS devices(@)", 42.9, -72.3),
    ("device :bbox 900m NNEAR devices(@, d3)", -17.0, 179.97),
    ("device :radius 900m NEAR devices(@, d3, d5)", -17.0, 179.97),
    ("device :radius 900m NEAR devices(@)", 67.0, 20.0),
    ("device INTERSECTS devices(@, d3) :radius 1500m", 42.9, -72.3),
    ("device :radius 1500m NIN devices(d3, d5)", 42.9, 179.97),
    ("device :radius 1500m INTERSECTS devices(d3, d5, d9) :bbox 500m", 42.9, 179.97),
])
def test_like_the_definition(spark, cut, text, lat, lon):
    rows = places(5, 1200, 30, lat, lon, 0.06, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    text += " { :layer L1 }"
    leaf = compile_rule(text).leaves[0]
    wide = 50_000.0 if leaf.op in ("nintersects", "nnear") else leaf.area.meters or 50.0
    pairs = []
    for r, d, y, x in seen([r for r in rows if r[6] == "L1"]):
        x += 360 * round((r[4] - x) / 360)
        near = abs(y - r[3]) <= wide / geo.DEGREE_M and abs(x - r[4]) <= wide / geo.DEGREE_M / cos(radians(r[3]))
        if d in leaf.refs or leaf.every and near:
            pairs.append((r[0], d, r[3], r[4], y, x))
    areas = {"mine": geo.area(leaf.area.shape, "lat", "lon", leaf.area.meters), "theirs": geo.area(leaf.other.shape, "other_lat", "other_lon", leaf.other.meters)}
    if leaf.area.shape and leaf.other.shape:
        test = geo.with_areas(areas, geo.areas_intersect("mine", "theirs"))
    elif leaf.other.shape:
        test = geo.place_in(leaf.other.shape, "other_lat", "other_lon", leaf.other.meters, "lat", "lon")
    else:
        test = geo.place_in(leaf.area.shape, "lat", "lon", leaf.area.meters, "other_lat", "other_lon")
    want = defaultdict(list)
    for p in spark.createDataFrame(pairs, "e long, d string, lat double, lon double, other_lat double, other_lon double").filter(~test if leaf.op in ("nintersects", "nnear", "nin") else test).collect():
        want[p.e].append(p.d)
    engine = Engine(spark)
    engine.add_rule(text, "r")
    got = {r.event_id: r.match[0].right.refs for r in engine.detect(df).collect()}
    assert got == {k: sorted(v) for k, v in want.items()} and len(got) > 50
    assert {r.event_id: r.n_refs for r in engine.counts(df).collect()} == {k: len(v) for k, v in want.items()}


def test_lists_are_made_where_they_stay(spark):
    """No pair is grouped, and no list goes back to its reading through a join."""
    df = spark.createDataFrame(places(1, 20, 5, 42.9, -72.3, 0.02), SCHEMA)
    engine = Engine(spark)
    engine.add_rule("device :bbox 900m NEAR devices(@, d3)", "r")
    plan = engine.detect(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    engine.add_rule("device :bbox 900m NEAR devices(@, d3) OR speed lt 5", "s")
    assert "Join" in engine.detect(df)._jdf.queryExecution().optimizedPlan().toString()
    assert {r["rule_id"]: r["count"] for r in engine.detect(df).groupBy("rule.rule_id").count().collect()}["s"] == 20


def test_one_hot_tile_is_cut(spark, cut):
    """All readings in one place: as many slabs as they are worth, each with a fair share."""
    readings = normalise(spark.createDataFrame(places(2, 2000, 40, 42.9, -72.3, 0.01), SCHEMA))
    leaf = compile_rule("device :bbox 900m NEAR devices(d3)").leaves[0]
    taken = []
    whole = sweep._cut
    try:
        sweep._cut = lambda *a: taken.append(whole(*a)) or taken[-1]
        device_hits(readings, readings, leaf)
    finally:
        sweep._cut = whole
    asked, held, slabs = taken[0]
    sizes = [r["count"] for r in asked.groupBy("slab").count().collect()]
    assert slabs >= 15 and max(sizes) < 300 and sum(sizes) == 2000


def test_a_device_meets_itself_only_where_it_may(spark, cut):
    rows = places(3, 800, 12, 42.9, -72.3, 0.02)
    df = spark.createDataFrame(rows, SCHEMA)
    for compat in (False, True):
        engine = Engine(spark, compat=compat)
        engine.add_rule("device :bbox 900m NEAR devices(@)", "r")
        engine.add_rule("device :bbox 900m NNEAR devices(@)", "s")
        want = defaultdict(int)
        for r, d, y, x in seen(rows, same=compat):
            want[r[0], "r" if abs(y - r[3]) <= 900 / geo.DEGREE_M and abs(x - r[4]) <= 900 / geo.DEGREE_M / cos(radians(r[3])) else "s"] += 1
        assert {(r.event_id, r.rule_id): r.n_refs for r in engine.counts(df).collect()} == want


def test_counts_of_other_rules(spark):
    df = spark.createDataFrame(places(3, 60, 5, 42.9, -72.3, 0.02), SCHEMA)
    engine = Engine(spark)
    engine.add_rule("device :bbox 900m NEAR devices(@) AND speed lt 5", "r")
    engine.add_rule("device :bbox 900m NEAR devices(@)", "s")
    got = defaultdict(dict)
    for r in engine.counts(df).collect():
        got[r.rule_id][r.event_id] = r.n_refs
    assert got["r"] == got["s"] and got["r"]


@pytest.mark.parametrize("lat", [0.0, 42.9, -59.0, 75.0])
@pytest.mark.parametrize(("mine", "other"), [("radius", "radius"), ("bbox", "bbox"), ("radius", "bbox"), ("bbox", "radius")])
def test_arithmetic_agrees_with_edges(spark, mine, other, lat):
    """What arithmetic decides, the edges decide alike, and it decides nearly all below 60 degrees."""
    rng = random.Random(9)
    rows = [(lat, 20.0, lat + rng.uniform(-0.06, 0.06), 20.0 + rng.uniform(-0.06, 0.06) / cos(radians(lat))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "lat double, lon double, other_lat double, other_lon double")
    areas = {"mine": geo.area(mine, "lat", "lon", 2500.0), "theirs": geo.area(other, "other_lat", "other_lon", 900.0)}
    for within, exact in ((False, geo.areas_intersect("mine", "theirs")), (True, geo.area_contains("mine", "theirs"))):
        yes, no = geo.areas_sooner(mine, 2500.0, other, 900.0, within)
        found = df.select(yes.alias("yes"), no.alias("no"), geo.with_areas(areas, exact).alias("exact")).collect()
        assert not [r for r in found if r.yes and not r.exact or r.no and r.exact]
        assert lat == 75.0 or sum(r.yes or r.no for r in found) > 2700 and any(r.yes for r in found)


def test_places_at_the_poles_and_the_antimeridian(spark, cut):
    rng = random.Random(4)
    points = [(k, rng.choice([-90.0, 89.99, 90.0, -89.95, -17.0, 42.9]) if k % 2 else rng.uniform(-90, 90), rng.choice([179.99, -179.99, -180.0, 0.0, 100.0]) if k % 3 else rng.uniform(-180, 180)) for k in range(600)]
    at = spark.createDataFrame(points, "place_id long, place_lat double, place_lon double")
    devices = at.select(F.col("place_id").alias("device_id"), F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon"))
    high, want = 10_000 / geo.DEGREE_M, set()
    for i, y, x in points:
        for j, y2, x2 in points:
            dx = min(abs(x - x2), 360 - abs(x - x2))
            if abs(y - y2) <= high and dx <= high / max(cos(radians(y)), 1e-6):
                want.add((i, j))
    got = [tuple(r) for r in stores.near_devices_of(at, devices, 10_000.0).collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {r.place_id: r.n for r in stores.near_counts_of(at, devices, 10_000.0).collect()}
    assert counts == {i: sum(1 for a, _ in want if a == i) for i, _, _ in points}


def test_a_layer_alone_keeps_lists_in_place(spark):
    """A rule with a layer but no trigger has no readings to keep besides its matches."""
    df = spark.createDataFrame(places(1, 40, 5, 42.9, -72.3, 0.02, 2), SCHEMA)
    engine = Engine(spark)
    engine.add_rule("device :bbox 900m NEAR devices(@) { :layer L1 }", "r")
    assert "Join" not in engine.detect(df)._jdf.queryExecution().optimizedPlan().toString()
    assert engine.detect(df).count() == engine.counts(df).count() > 0
