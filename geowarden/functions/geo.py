"""Geometry as Spark SQL expressions: no Python in the evaluation of a predicate.

Areas and shapes are arrays of edges ``struct<y1, x1, y2, x2>`` (y latitude, x longitude, degrees,
planar); a point is one edge of no length.  An object is an array of parts ``struct<fill, edges>``;
holes are further edges of a filled part (even-odd).  Borders belong to what they bound.
"""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
DEGREE_M = RADIUS_M * pi / 180
EDGE = "struct<y1:double,x1:double,y2:double,x2:double>"
PARTS = f"array<struct<fill:boolean,edges:array<{EDGE}>>>"
CIRCLE_STEPS = 12


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def rounded_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: int = 50) -> Column:
    return (F.round(haversine(lat1, lon1, lat2, lon2) / unit) * unit).cast("long")


def half_box(lat: Column, meters: Column | float) -> tuple[Column, Column]:
    """Half the height and width, in degrees, of the box that reaches ``meters`` from its centre."""
    m = F.lit(meters) if isinstance(meters, (int, float)) else meters
    high = m / DEGREE_M
    return high, high / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))


def _edges(points: list[tuple[str, str]]) -> str:
    ring = [*points[1:], points[0]]
    return "array(" + ", ".join(f"named_struct('y1', {a[0]}, 'x1', {a[1]}, 'y2', {b[0]}, 'x2', {b[1]})" for a, b in zip(points, ring, strict=True)) + ")"


def point_area(lat: str, lon: str) -> str:
    return _edges([(lat, lon)])


def box_area(lat: str, lon: str, meters: float) -> str:
    y = f"{meters / DEGREE_M!r}D"
    x = f"({y} / greatest(cos(radians({lat})), 1e-6D))"
    return _edges([(f"({lat} - {y})", f"({lon} - {x})"), (f"({lat} - {y})", f"({lon} + {x})"), (f"({lat} + {y})", f"({lon} + {x})"), (f"({lat} + {y})", f"({lon} - {x})")])


def circle_area(lat: str, lon: str, meters: float, steps: int = CIRCLE_STEPS) -> str:
    """Polygon of destination points at even bearings, from north against the clock."""
    d, points = meters / RADIUS_M, []
    for k in range(steps):
        b = radians(-360 * k / steps)
        y = f"asin(sin(radians({lat})) * {cos(d)!r}D + cos(radians({lat})) * ({sin(d) * cos(b)!r}D))"
        x = f"(radians({lon}) + atan2(cos(radians({lat})) * ({sin(b) * sin(d)!r}D), {cos(d)!r}D - sin(radians({lat})) * sin({y})))"
        points.append((f"degrees({y})", f"degrees({x})"))
    ends = ", ".join(f"named_struct('y', {y}, 'x', {x})" for y, x in points)
    return f"transform(array({ends}), (c, i) -> named_struct('y1', c.y, 'x1', c.x, 'y2', c.y, 'x2', c.x))"


def area(shape: str | None, lat: str, lon: str, meters: float) -> str:
    """SQL of an area's edges around the columns of a place."""
    if shape is None or meters <= 0:
        return point_area(lat, lon)
    return circle_area(lat, lon, meters) if shape == "radius" else box_area(lat, lon, meters)


def closed(ring: str) -> str:
    """SQL of the edges between corners that a circle's edges still lack."""
    return f"transform({ring}, (c, i) -> named_struct('y1', c.y1, 'x1', c.x1, 'y2', element_at({ring}, (i + 1) % size({ring}) + 1).y1, 'x2', element_at({ring}, (i + 1) % size({ring}) + 1).x1))"


def with_areas(areas: dict[str, str], test: str) -> Column:
    """A test over named areas, each worked out once per row: names are lambda variables.

    As columns of a projection they would be copied to every place where the test names them.
    """
    for name, sql in reversed(areas.items()):
        test = f"exists(array({sql}), {name}_ring -> exists(array({closed(f'{name}_ring')}), {name} -> {test}))"
    return F.expr(test)


def _cross(oy: str, ox: str, ay: str, ax: str, by: str, bx: str) -> str:
    return f"(({ax} - {ox}) * ({by} - {oy}) - ({ay} - {oy}) * ({bx} - {ox}))"


def _meet(e: str, f: str) -> str:
    """Two edges share a point: boxes overlap and each straddles the other's line."""
    c = lambda s, t, k: _cross(f"{s}.y1", f"{s}.x1", f"{s}.y2", f"{s}.x2", f"{t}.y{k}", f"{t}.x{k}")
    over = " AND ".join(f"greatest({e}.{v}1, {e}.{v}2) >= least({f}.{v}1, {f}.{v}2) AND greatest({f}.{v}1, {f}.{v}2) >= least({e}.{v}1, {e}.{v}2)" for v in "xy")
    return f"({over} AND {c(e, f, 1)} * {c(e, f, 2)} <= 0 AND {c(f, e, 1)} * {c(f, e, 2)} <= 0)"


def _inside(y: str, x: str, edges: str, name: str) -> str:
    """A point lies in the area of the edges or on one of them."""
    n = name
    crossing = f"size(filter({edges}, {n} -> ({n}.y1 > {y}) <> ({n}.y2 > {y}) AND {x} < ({n}.x2 - {n}.x1) * ({y} - {n}.y1) / ({n}.y2 - {n}.y1) + {n}.x1)) % 2 = 1"
    border = f"exists({edges}, {n} -> {y} BETWEEN least({n}.y1, {n}.y2) AND greatest({n}.y1, {n}.y2) AND {x} BETWEEN least({n}.x1, {n}.x2) AND greatest({n}.x1, {n}.x2) AND {_cross(f'{n}.y1', f'{n}.x1', f'{n}.y2', f'{n}.x2', y, x)} = 0)"
    return f"({crossing} OR {border})"


def areas_intersect(a: str, b: str) -> str:
    """Two convex areas (columns of edges) share a point."""
    return (f"(exists({a}, e -> exists({b}, f -> {_meet('e', 'f')})) OR {_inside(f'{a}[0].y1', f'{a}[0].x1', b, 'g')} OR {_inside(f'{b}[0].y1', f'{b}[0].x1', a, 'h')})")


def area_contains(a: str, b: str) -> str:
    """A convex area contains another."""
    return (f"forall({b}, e -> {_inside('e.y1', 'e.x1', a, 'g')})")


def object_intersects(parts: str, a: str) -> str:
    """An object shares a point with a convex area."""
    edge = f"exists(p.edges, e -> exists({a}, f -> {_meet('e', 'f')}))"
    around = f"(p.fill AND {_inside(f'{a}[0].y1', f'{a}[0].x1', 'p.edges', 'g')})"
    within = f"{_inside('p.edges[0].y1', 'p.edges[0].x1', a, 'h')}"
    return (f"exists({parts}, p -> {edge} OR {around} OR {within})")


def object_within(parts: str, a: str) -> str:
    """An object lies within a convex area: all its vertices do."""
    return (f"forall({parts}, p -> forall(p.edges, e -> {_inside('e.y1', 'e.x1', a, 'g')} AND {_inside('e.y2', 'e.x2', a, 'h')}))")


def relations(pairs: DataFrame, shape: str | None, meters: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``pairs`` (a place and an object's parts) with ``intersects``, ``within`` (the object lies in the area around the place) and ``contains`` (the object holds the place)."""
    mine = {"mine": area(shape, lat, lon, meters)}
    return pairs.select("*", with_areas(mine, object_intersects("parts", "mine")).alias("intersects"), with_areas(mine, object_within("parts", "mine")).alias("within"), F.expr(f"exists(parts, p -> p.fill AND {_inside(lat, lon, 'p.edges', 'g')})").alias("contains"))


def boundary(parts: str = "parts") -> Column:
    """All edges of an object."""
    return F.flatten(F.transform(parts, lambda p: p["edges"]))


def clamped(meters: Column | float, least: float = 50.0, most: float = 50_000.0) -> Column:
    """A search distance within its limits; nothing, zero and less are the least."""
    m = meters if isinstance(meters, Column) else F.lit(meters)
    return F.least(F.greatest(F.coalesce(m.cast("double"), F.lit(least)), F.lit(least)), F.lit(most))


_AT = "named_struct('ax', (e.x1 - lon) * cos(radians(lat)), 'ay', e.y1 - lat, 'dx', (e.x2 - e.x1) * cos(radians(lat)), 'dy', e.y2 - e.y1)"
_SHARE = "greatest(0D, least(1D, -(v.ax * v.dx + v.ay * v.dy) / greatest(v.dx * v.dx + v.dy * v.dy, 1e-18D)))"
#: Squared distance, in degrees of latitude, from a place (lat, lon) to the nearest edge and to the farthest corner of an object.
_NEAREST = f"array_min(transform(transform(flatten(parts.edges), e -> {_AT}), v -> pow(v.ax + {_SHARE} * v.dx, 2) + pow(v.ay + {_SHARE} * v.dy, 2)))"
_FARTHEST = f"array_max(transform(transform(flatten(parts.edges), e -> {_AT}), v -> greatest(pow(v.ax, 2) + pow(v.ay, 2), pow(v.ax + v.dx, 2) + pow(v.ay + v.dy, 2))))"


def sooner(shape: str | None, meters: float, meets: Column, within: Column) -> tuple[Column, Column]:
    """The tests of an object against an area, after arithmetic on the object's box has decided what it can.

    Columns: lat, lon, parts, min_lat, min_lon, max_lat, max_lon.  What lies clearly outside the
    area or, by its first corner or its whole box, clearly inside it needs no test of edges.
    """
    lat, lon, y, x = F.col("lat"), F.col("lon"), F.expr("parts[0].edges[0].y1"), F.expr("parts[0].edges[0].x1")
    inside_y, inside_x = F.greatest("min_lat", F.least("max_lat", lat)), F.greatest("min_lon", F.least("max_lon", lon))
    if shape is None or meters <= 0:
        return F.when((inside_y != lat) | (inside_x != lon), False).otherwise(meets), within
    high, wide = half_box(lat, meters)
    far_y, far_x = F.greatest(lat - F.col("min_lat"), F.col("max_lat") - lat), F.greatest(lon - F.col("min_lon"), F.col("max_lon") - lon)
    if shape == "bbox":
        out = (F.abs(inside_y - lat) > 1.001 * high) | (F.abs(inside_x - lon) > 1.001 * wide)
        some = (F.abs(y - lat) < 0.999 * high) & (F.abs(x - lon) < 0.999 * wide)
        every = (far_y < 0.999 * high) & (far_x < 0.999 * wide)
        over = (far_y > 1.001 * high) | (far_x > 1.001 * wide)
    else:
        # A regular 12-gon holds all within cos(15 degrees) = 0.966 of its radius and nothing beyond it.
        # Below 60 degrees of latitude degrees scaled at the place are within a hundredth of the truth.
        level = F.abs(lat) < 60
        box = F.pow((inside_y - lat) / high, 2) + F.pow((inside_x - lon) / wide, 2)
        near, far = F.expr(_NEAREST) / F.pow(high, 2), F.expr(_FARTHEST) / F.pow(high, 2)
        around = F.expr(f"exists(parts, p -> p.fill AND {_inside('lat', 'lon', 'p.edges', 'g')})")
        corner = F.pow((y - lat) / high, 2) + F.pow((x - lon) / wide, 2)
        outside = level & (box > 1.04)
        meets = F.when(outside, False).when(~level, meets).when(corner < 0.9, True).when(near < 0.9, True).when(near > 1.04, around).otherwise(meets)
        within = F.when(outside | level & (corner > 1.04), False).when(~level, within).when(far < 0.9, True).when(far > 1.04, False).otherwise(within)
        return meets, within
    return F.when(out, False).when(some, True).otherwise(meets), F.when(out | over, False).when(every, True).otherwise(within)


def areas_sooner(mine: str, m: float, other: str, o: float, within: bool) -> tuple[Column, Column]:
    """Whether the areas around (lat, lon) and (other_lat, other_lon) meet for certain, or (``within``) the first holds the second; and whether they don't for certain.

    A regular 12-gon holds all within cos(15 degrees) of its radius and nothing beyond it.  Degrees
    scaled at its centre are off by less than ``off`` below 60 degrees of latitude.
    """
    lat, lat2 = F.col("lat"), F.col("other_lat")
    dy, dx = F.abs(lat2 - lat), F.abs(F.col("other_lon") - F.col("lon"))
    (high, wide), (high2, wide2) = half_box(lat, m), half_box(lat2, o)
    both = (mine, other)
    off = 1e-9 if both == ("bbox", "bbox") else 0.002 + 4 * (m + o) / RADIUS_M
    low, up = cos(pi / CIRCLE_STEPS) * (1 - off), 1 + off
    level = F.lit(True) if both == ("bbox", "bbox") else (F.abs(lat) < 60) & (F.abs(lat2) < 60)
    if both == ("bbox", "bbox"):
        over_y, over_x = (dy + high2, dx + wide2) if within else (dy - high2, dx - wide2)
        yes, no = (over_y < (1 - off) * high) & (over_x < (1 - off) * wide), (over_y > up * high) | (over_x > up * wide)
    elif both == ("radius", "radius"):
        d = haversine(lat, F.col("lon"), lat2, F.col("other_lon"))
        yes, no = (d + up * o < low * m, d + low * o > up * m) if within else (d < low * (m + o), d > up * (m + o))
    elif mine == "radius":
        y, x = (dy + high2, dx + wide2) if within else (F.greatest(dy - high2, F.lit(0.0)), F.greatest(dx - wide2, F.lit(0.0)))
        u = F.pow(y / high, 2) + F.pow(x / wide, 2)
        yes, no = u < low**2, u > up**2
    elif within:
        yes, no = (dy + up * high2 < (1 - off) * high) & (dx + up * wide2 < (1 - off) * wide), (dy + low * high2 > up * high) | (dx + low * wide2 > up * wide)
    else:
        u = F.pow(F.greatest(dy - high, F.lit(0.0)) / high2, 2) + F.pow(F.greatest(dx - wide, F.lit(0.0)) / wide2, 2)
        yes, no = u < low**2, u > up**2
    return level & yes, level & no


def place_in(shape: str | None, lat: str, lon: str, meters: float, y: str, x: str) -> Column:
    """A place (columns ``y, x``) lies in the area around another: plain arithmetic unless the area is a circle."""
    if shape is None or meters <= 0:
        return F.expr(f"{y} = {lat} AND {x} = {lon}")
    if shape == "bbox":
        high = f"{meters / DEGREE_M!r}D"
        return F.expr(f"abs({y} - {lat}) <= {high} AND abs({x} - {lon}) <= {high} / greatest(cos(radians({lat})), 1e-6D)")
    # A regular 12-gon holds all within cos(15 degrees) = 0.966 of its radius and nothing beyond it.
    d = haversine(F.col(lat), F.col(lon), F.col(y), F.col(x))
    exact = with_areas({"mine": circle_area(lat, lon, meters)}, _inside(y, x, "mine", "g"))
    return F.when(d > 1.001 * meters, False).when((d < 0.96 * meters) & (F.abs(lat) < 80), True).otherwise(exact)
