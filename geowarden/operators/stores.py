"""Stores as DataFrames: latest positions, objects, rules, and searches over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geowarden.functions.geo import DEGREE_M, half_box
from geowarden.operators.candidates import LEAST_M, MOST_M, beside, in_cell, in_levels, over_levels
from geowarden.operators.sweep import Search, swept


def latest(telemetry: DataFrame) -> DataFrame:
    """The last reading of each device of a layer, by time and then event_id (one aggregate, no sort)."""
    last = F.max_by(F.struct(*telemetry.columns), F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id")))
    return telemetry.groupBy("layer_id", "device_id").agg(last.alias("r")).select(*[f"r.{c}" for c in telemetry.columns])


def upsert(devices: DataFrame, newer: DataFrame) -> DataFrame:
    """Latest positions after newer readings."""
    return latest(devices.unionByName(newer, allowMissingColumns=True))


def delete(store: DataFrame, ids: DataFrame | list[str], key: str) -> DataFrame:
    """A store without the rows whose ``key`` is listed, in lookups and searches alike."""
    if isinstance(ids, list):
        return store.filter(~F.col(key).isin(ids))
    return store.join(ids.select(key).distinct(), key, "left_anti")


def add(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A store with new rows; ids that it has already are not added again."""
    return store.unionByName(rows.dropDuplicates([key]).join(store.select(key), key, "left_anti"), allowMissingColumns=True)


def lookup(store: DataFrame, key: str, value: str) -> DataFrame:
    return store.filter(F.col(key) == value)


def in_cells(store: DataFrame, cell_y: int, cell_x: int, size: float) -> DataFrame:
    """What a store has in a cell: devices whose place, objects whose box lies in it (each object once)."""
    if "lat" in store.columns:
        return in_cell(store, size).filter((F.col("cell_y") == cell_y) & (F.col("cell_x") == cell_x)).drop("cell_y", "cell_x")
    low, high = F.lit(cell_y * size), F.lit(cell_y * size + size)
    left, right = F.lit(cell_x * size), F.lit(cell_x * size + size)
    return store.filter((F.col("max_lat") >= low) & (F.col("min_lat") < high) & (F.col("max_lon") >= left) & (F.col("min_lon") < right))


def _reach(meters: float) -> float:
    return min(max(meters, 1.0), MOST_M) if meters else LEAST_M


def near_devices(devices: DataFrame, lat: float, lon: float, meters: float) -> DataFrame:
    """Devices whose position lies in the box around a place, of any layer."""
    return devices.filter(_box(F.lit(lat), F.lit(lon), _reach(meters)))


def _box(lat: Column, lon: Column, meters: float) -> Column:
    y, x = half_box(lat, meters)
    here = beside(lon, F.col("lon"))
    return (F.col("lat") >= lat - y) & (F.col("lat") <= lat + y) & (here >= lon - x) & (here <= lon + x)


def _search_of(places: DataFrame, devices: DataFrame, meters: float, out: str) -> DataFrame:
    m = _reach(meters)
    half = F.least(half_box(F.col("place_lat"), m)[1], F.lit(180.0))
    none, start, layer = (lambda like: F.lit(None).cast(like)), F.lit(0).cast("long"), F.lit("").alias("layer_id")
    device, place = devices.schema["device_id"].dataType, places.schema["place_id"].dataType
    asked = places.select(layer, none(device).alias("device"), F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon"), half.alias("half"), start.alias("at"), F.col("place_id").alias("id"), F.struct("place_id").alias("row"))
    held = devices.select(layer, F.col("device_id").alias("device"), "lat", "lon", start.alias("at"), none(place).alias("id"), none("long").alias("until"), none(place).alias("until_id"))
    return swept(asked, held, Search(m / DEGREE_M, out, same=True, timed=False))


def near_devices_of(places: DataFrame, devices: DataFrame, meters: float) -> DataFrame:
    """``place_id, device_id`` of the devices in the boxes around many places (place_id, place_lat, place_lon)."""
    return _search_of(places, devices, meters, "pairs").select("row.place_id", F.col("other_id").alias("device_id"))


def near_counts_of(places: DataFrame, devices: DataFrame, meters: float) -> DataFrame:
    """``place_id, n``: how many rows near_devices_of() has of a place, without making them."""
    return _search_of(places, devices, meters, "counts").groupBy("row.place_id").agg(F.sum("n").alias("n"))


def near_objects(objects: DataFrame, layer: str, lat: float, lon: float, meters: float) -> DataFrame:
    """Objects of a layer whose box meets the box around a place, each once."""
    y, x = half_box(F.lit(lat), _reach(meters))
    return objects.filter((F.col("layer_id") == layer) & (F.col("max_lat") >= lat - y) & (F.col("min_lat") <= lat + y) & (F.col("max_lon") >= lon - x) & (F.col("min_lon") <= lon + x))


def walk_rules(readings: DataFrame, rules: DataFrame, size: float = 0.1) -> DataFrame:
    """``event_id, rule_id`` of the rules (rule_id, layer_id, min_lat, min_lon, max_lat, max_lon) whose box holds a reading."""
    filed = over_levels(rules, size, F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("max_lon"))
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    return in_levels(readings.select("event_id", "layer_id", "lat", "lon"), size).join(filed, ["layer_id", "level", "cell_y", "cell_x"]).filter(inside).select("event_id", "rule_id")
