"""GeoJSON objects: nested collections are flattened to parts, once, on ingest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geowarden.functions.geo import PARTS
from geowarden.operators.candidates import over_cells

KINDS = {"Point": "point", "MultiPoint": "multiPoint", "LineString": "line", "MultiLineString": "multiLine", "Polygon": "polygon", "MultiPolygon": "multiPolygon", "GeometryCollection": "collection", "Feature": "feature", "FeatureCollection": "featureCollection"}
SCHEMA = f"object_id string, layer_id string, kind string, parts {PARTS}, min_lat double, min_lon double, max_lat double, max_lon double, center_lat double, center_lon double"


def _edges(points: list, closed: bool) -> list[dict]:
    if any(len(p) < 2 for p in points):
        raise ValueError("a position has two numbers")
    if closed and (len(points) < 4 or points[0][:2] != points[-1][:2]):
        raise ValueError("a ring has four positions and ends where it begins")
    ends = points[1:] if len(points) > 1 else points
    return [{"y1": float(a[1]), "x1": float(a[0]), "y2": float(b[1]), "x2": float(b[0])} for a, b in zip(points, ends, strict=False)]


def parts(shape: dict) -> list[dict]:
    """The parts of a geometry, feature or collection of any depth; positions are longitude, latitude."""
    out, todo = [], [shape]
    while todo:
        g = todo.pop()
        kind, at = g.get("type"), g.get("coordinates")
        if kind in ("FeatureCollection", "GeometryCollection"):
            todo += reversed(g["features" if kind == "FeatureCollection" else "geometries"])
        elif kind == "Feature":
            if g.get("geometry"):
                todo.append(g["geometry"])
        elif kind == "Point":
            out.append({"fill": False, "edges": _edges([at], False)})
        elif kind == "MultiPoint":
            out += [{"fill": False, "edges": _edges([p], False)} for p in at]
        elif kind == "LineString":
            out.append({"fill": False, "edges": _edges(at, False)})
        elif kind == "MultiLineString":
            out += [{"fill": False, "edges": _edges(line, False)} for line in at]
        elif kind in ("Polygon", "MultiPolygon"):
            out += [{"fill": True, "edges": [e for ring in p for e in _edges(ring, True)]} for p in ([at] if kind == "Polygon" else at)]
        else:
            raise ValueError(f"unknown geometry {kind!r}")
    if not out:
        raise ValueError("no geometry")
    return out


def parse_object(text: str) -> tuple[str, list[dict]] | None:
    """Kind and parts of a GeoJSON text; None if it isn't valid."""
    try:
        shape = json.loads(text)
        return KINDS[shape["type"]], parts(shape)
    except (ValueError, KeyError, TypeError, AttributeError, IndexError):
        return None


def read_objects(rows: DataFrame) -> DataFrame:
    """Objects from ``object_id, layer_id, geojson``.  Rows without an id or a valid geometry are left out (see invalid())."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_object(t) if t else None for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], _parts_type())], ["object_id", "layer_id", "kind", "parts"])

    parsed = rows.select(F.col("object_id").cast("string"), F.coalesce(F.col("layer_id").cast("string"), F.lit("")).alias("layer_id"), "geojson").mapInArrow(run, f"object_id string, layer_id string, kind string, parts {PARTS}")
    return with_boxes(parsed.filter("object_id is not null and object_id <> '' and parts is not null"))


def invalid(rows: DataFrame) -> DataFrame:
    """The rows that read_objects() leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("geojson")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("object_id")).to_pylist()
            yield batch.filter(pa.array([i is None or str(i) == "" or t is None or parse_object(t) is None for i, t in zip(ids, texts, strict=True)]))

    return rows.mapInArrow(run, rows.schema)


def _parts_type() -> pa.DataType:
    edge = pa.struct([(c, pa.float64()) for c in ("y1", "x1", "y2", "x2")])
    return pa.list_(pa.struct([("fill", pa.bool_()), ("edges", pa.list_(edge))]))


def with_boxes(objects: DataFrame) -> DataFrame:
    """Adds the box and its centre to objects with parts."""
    ends = {v: F.expr(f"concat(transform(flatten(parts.edges), e -> e.{v}1), transform(flatten(parts.edges), e -> e.{v}2))") for v in "yx"}
    boxed = objects.select("object_id", "layer_id", "kind", "parts", F.array_min(ends["y"]).alias("min_lat"), F.array_min(ends["x"]).alias("min_lon"), F.array_max(ends["y"]).alias("max_lat"), F.array_max(ends["x"]).alias("max_lon"))
    return boxed.select("*", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("center_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("center_lon"))


def cover(objects: DataFrame, size: float = 0.1) -> DataFrame:
    """``object_id, layer_id, cell_y, cell_x`` of the grid cells that each object's shape meets."""
    from geowarden.functions.geo import object_intersects

    filed = over_cells(objects, size, F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("max_lon"))
    y, x = F.col("cell_y") * size, F.col("cell_x") * size
    corners = [(y, x), (y, x + size), (y + size, x + size), (y + size, x)]
    ring = F.array(*[F.struct(a[0].alias("y1"), a[1].alias("x1"), b[0].alias("y2"), b[1].alias("x2")) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)])
    return filed.withColumn("cell", ring).filter(F.expr(object_intersects("parts", "cell"))).select("object_id", "layer_id", "cell_y", "cell_x")


def index_counts(cells: DataFrame) -> DataFrame:
    """``object_id, n_cells``: distinct cells of each object."""
    return cells.groupBy("object_id").agg(F.count_distinct("cell_y", "cell_x").alias("n_cells"))


def cells_by_host(cells: DataFrame, hosts: int) -> DataFrame:
    """``host, cell_y, cell_x, objects``: the distinct cells by the host that a hash of the cell gives them to."""
    at = cells.select(F.pmod(F.col("cell_y") * 31 + F.col("cell_x"), F.lit(hosts)).alias("host"), "cell_y", "cell_x", "object_id")
    return at.groupBy("host", "cell_y", "cell_x").agg(F.count_distinct("object_id").alias("objects"))


def cells_to_geojson(cells: DataFrame, size: float = 0.1) -> DataFrame:
    """``object_id, geojson``: an object's cells as a FeatureCollection of squares."""
    y, x = F.col("cell_y") * size, F.col("cell_x") * size
    at = lambda a, b: F.array(b, a)
    ring = F.array(at(y, x), at(y, x + size), at(y + size, x + size), at(y + size, x), at(y, x))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("cell_y", "cell_x").alias("properties"))
    return cells.groupBy("object_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("cell_y", "cell_x", feature.alias("f")))), lambda c: c["f"]).alias("features"))).alias("geojson"))
