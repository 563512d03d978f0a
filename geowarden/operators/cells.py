"""Grid cells of places and boxes, round the antimeridian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geowarden.functions.geo import DEGREE_M


def cell_size(meters: float, least: float = 0.001) -> float:
    """Cells about as wide as the search box is high; an even number of them goes round the world."""
    wide = max(least, 2 * meters / DEGREE_M)
    return 180.0 / max(1, int(180.0 / wide + 1e-9))


def _half(size: float | Column) -> Column:
    """Cells on half of a parallel."""
    return F.round(180.0 / size).cast("long") if isinstance(size, Column) else F.lit(round(180.0 / size)).cast("long")


def _round(cell: Column, size: float | Column) -> Column:
    """Columns of cells beyond the antimeridian are those of its other side."""
    return F.pmod(cell + _half(size), 2 * _half(size)) - _half(size)


def in_cell(df: DataFrame, size: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("cell_y", F.floor(F.col(lat) / size)).withColumn("cell_x", _round(F.floor(F.col(lon) / size), size))


def over_cells(df: DataFrame, size: float | Column, low_y: Column, low_x: Column, high_y: Column, high_x: Column) -> DataFrame:
    """One row for each cell that a box overlaps, round the antimeridian too; a box wider than the world has every column once."""
    rows = df.withColumn("cell_y", F.explode(F.sequence(F.floor(F.greatest(low_y, F.lit(-90.0)) / size), F.floor(F.least(high_y, F.lit(90.0)) / size))))
    first = F.floor(low_x / size)
    last = F.least(F.floor(high_x / size), first + 2 * _half(size) - 1)
    return rows.withColumn("_x", F.explode(F.sequence(first, last))).withColumn("cell_x", _round(F.col("_x"), size)).drop("_x")


def beside(lon: Column, other: Column) -> Column:
    """A longitude as the one within 180 degrees of another."""
    return other + 360.0 * F.round((lon - other) / 360.0)
