"""Candidate joins: always an equality on layer and grid cell, the exact test as residual.

One side of a join falls into one cell, the other is filed under every cell that its box, grown by
the search distance, overlaps, so a pair meets in one cell only and nothing has to be deduplicated.
Cells go round the antimeridian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geowarden.functions.geo import DEGREE_M, half_box
from geowarden.functions.words import seconds
from geowarden.operators.cells import _round, beside, cell_size, in_cell, over_cells
from geowarden.operators.sweep import Search, swept

MOST_M = 50_000.0
LEAST_M = 50.0
#: Sizes of cells: of the search, and each level above it so many times as wide; a box is filed at the level where it spans about so many cells.
LEVEL, SPAN = 8, 4
#: Lengths of time blocks in seconds (a minute to 32 years): an interval is filed under blocks of a sixteenth of its length or more.
BLOCKS_S = tuple(60 * 16**k for k in range(6))
SHARE = 16


def level_sizes(size: float) -> list[float]:
    """Cell sizes of all levels, from ``size`` to a quarter of the world."""
    out = [size]
    while out[-1] < 45.0:
        out.append(180.0 / max(1, int(180.0 / (out[-1] * LEVEL))))
    return out


def over_levels(df: DataFrame, size: float, low_y: Column, low_x: Column, high_y: Column, high_x: Column) -> DataFrame:
    """One row for each cell that a box overlaps at the level of its size, so that large boxes have few rows too: level, cell_y, cell_x."""
    sizes = level_sizes(size)
    span = F.greatest(high_y - low_y, high_x - low_x)
    level = F.lit(len(sizes) - 1)
    for k in reversed(range(len(sizes) - 1)):
        level = F.when(span <= SPAN * sizes[k], k).otherwise(level)
    each = F.array(*map(F.lit, sizes))
    return over_cells(df.withColumn("level", level).withColumn("_size", F.get(each, F.col("level"))), F.col("_size"), low_y, low_x, high_y, high_x).drop("_size")


def in_levels(df: DataFrame, size: float) -> DataFrame:
    """A row for each level with the cell of a place."""
    at = [F.struct(F.lit(k).alias("level"), F.floor(F.col("lat") / one).alias("y"), _round(F.floor(F.col("lon") / one), one).alias("x")) for k, one in enumerate(level_sizes(size))]
    return df.withColumn("_at", F.explode(F.array(*at))).select("*", "_at.level", F.col("_at.y").alias("cell_y"), F.col("_at.x").alias("cell_x")).drop("_at")


def near_objects(readings: DataFrame, objects: DataFrame, meters: float, every: bool, refs: tuple[str, ...]) -> DataFrame:
    """``event_id, lat, lon``, the object's id, parts and box: the objects that a leaf looks at for each reading.

    All objects of the layer whose box meets the box around the reading, and the named ones.  The
    longitude of a reading is given within 180 degrees of the object's.
    """
    thin = readings.select("event_id", "layer_id", "lat", "lon")
    box = ["min_lat", "min_lon", "max_lat", "max_lon"]
    named = objects.select("layer_id", "object_id", "parts", *box)
    out = None
    if refs:
        out = thin.join(named.filter(F.col("object_id").isin(list(refs))), "layer_id")
    if every:
        m = min(max(meters, 0.0) or LEAST_M, MOST_M)
        size = cell_size(m, 0.1)
        top = F.greatest(F.abs("min_lat"), F.abs("max_lat")) + m / DEGREE_M
        y, x = half_box(F.least(top, F.lit(89.9)), m)
        filed = over_levels(objects.select("layer_id", "object_id", *box), size, F.col("min_lat") - y, F.col("min_lon") - x, F.col("max_lat") + y, F.col("max_lon") + x)
        y, x = half_box(F.col("lat"), m)
        lon = beside((F.col("min_lon") + F.col("max_lon")) / 2, F.col("lon"))
        meets = (F.col("max_lat") >= F.col("lat") - y) & (F.col("min_lat") <= F.col("lat") + y) & (F.col("max_lon") >= lon - x) & (F.col("min_lon") <= lon + x)
        found = in_levels(thin, size).join(filed, ["layer_id", "level", "cell_y", "cell_x"]).filter(meets).select("layer_id", "event_id", "lat", "lon", "object_id")
        if refs:
            found = found.filter(~F.col("object_id").isin(list(refs)))
        # Shapes come last: they are looked up by id, not copied into every cell.
        found = found.join(named, ["layer_id", "object_id"])
        out = found if out is None else out.unionByName(found)
    return out.withColumn("lon", beside((F.col("min_lon") + F.col("max_lon")) / 2, F.col("lon")))


def intervals(history: DataFrame) -> DataFrame:
    """Each reading with the moment ``(until, until_id)`` of its device's next one; null for the last."""
    w = Window.partitionBy("layer_id", "device_id").orderBy("at", "event_id")
    rows = history.select("event_id", "device_id", "layer_id", "lat", "lon", seconds().alias("at"))
    return rows.withColumn("until", F.lead("at").over(w)).withColumn("until_id", F.lead("event_id").over(w))


def _blocks(held: DataFrame) -> DataFrame:
    """One row for each time block of an interval: ``span`` (the block's length; 0 for intervals without an end, which are filed once) and ``block``."""
    length = F.col("until") - F.col("at")
    span = F.lit(BLOCKS_S[-1])
    for s in reversed(BLOCKS_S[:-1]):
        span = F.when(length <= SHARE * s, s).otherwise(span)
    span = F.when(F.col("until").isNull(), 0).otherwise(span).cast("long")
    rows = held.withColumn("span", span)
    some = F.when(F.col("span") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("at") / F.greatest("span", F.lit(1))), F.floor(F.col("until") / F.greatest("span", F.lit(1)))))
    return rows.withColumn("block", F.explode(some))


def _positions(history: DataFrame, layers: bool = True) -> DataFrame:
    """What each device holds from one reading to its next, as swept() takes it."""
    held = intervals(history).filter(F.col("device_id").isNotNull()).withColumnRenamed("event_id", "id").withColumnRenamed("device_id", "device")
    return held if layers else held.withColumn("layer_id", F.lit(""))


def _asked(readings: DataFrame, meters: float, columns: list[str], same: bool) -> DataFrame:
    """Readings as swept() takes them, with the named columns as their row."""
    half = F.least(half_box(F.least(F.abs("lat"), F.lit(89.9)), meters)[1], F.lit(180.0))
    some = readings if same else readings.filter(F.col("device_id").isNotNull())
    return some.select("layer_id", F.col("device_id").alias("device"), "lat", "lon", half.alias("half"), seconds().alias("at"), F.col("event_id").alias("id"), F.struct(*columns).alias("row"))


def search_m(meters: float, wide: bool = False) -> float:
    return MOST_M if wide else min(meters or LEAST_M, MOST_M)


def near_devices(readings: DataFrame, history: DataFrame, meters: float, every: bool, refs: tuple[str, ...], wide: bool = False, same: bool = False, layers: bool = True) -> DataFrame:
    """``event_id, lat, lon, other_id, other_lat, other_lon``: last positions, before each reading, of other devices.

    As-of join: a position holds from its reading until the device's next one, both excluded at
    the reading's own moment (ties of the second by event_id).  ``every`` looks at all positions in
    the search box and at those of ``refs``, else at those of ``refs`` only.  ``wide`` searches
    50 km; ``same`` lets a device meet its own last position; ``layers=False`` looks across layers.
    Longitudes of others are given within 180 degrees of the reading's.
    """
    m, named = search_m(meters, wide), F.col("device").isin(list(refs))
    asked, held = _asked(readings, m, ["event_id", "lat", "lon"], same), _positions(history, layers)
    asked = asked if layers else asked.withColumn("layer_id", F.lit(""))
    out = None
    if refs:
        out = swept(asked, held.filter(named), Search(None, "pairs", same=same))
    if every:
        found = swept(asked, held.filter(~named) if refs else held, Search(m / DEGREE_M, "pairs", same=same))
        out = found if out is None else out.unionByName(found)
    return out.select("row.*", "other_id", "other_lat", "other_lon")


def matched_devices(readings: DataFrame, history: DataFrame, search: Search, refs: tuple[str, ...] | None, without: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """The named columns of each reading (event_id) with the ``refs`` (or ``n``) of the other devices whose last position passes the search's test: those of ``refs``, or all but ``without``."""
    held = _positions(history)
    if refs is not None:
        held = held.filter(F.col("device").isin(list(refs)))
    elif without:
        held = held.filter(~F.col("device").isin(list(without)))
    meters = search.high * DEGREE_M if search.high is not None else 0.0
    return swept(_asked(readings, meters, columns or ["event_id"], search.same), held, search).select("row.*", "n" if search.out == "counts" else "refs")
