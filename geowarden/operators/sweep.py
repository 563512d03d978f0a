"""Readings against the positions of devices, without a shuffle of pairs.

Both sides are brought to tiles some search boxes wide, and tiles with many readings are cut into
slabs of time.  A reading lies in one tile and slab, a position is filed in all that can see it, so
all matches of a reading come about in one place and leave it as one row: a list, a count, or pairs
for a test that Spark makes.  A tile's rows pass through a worker in order; what is held in memory is
the positions of one slab and a chunk of readings.  The tests are those of ``functions.geo``, on
arrays; what arithmetic leaves open between a circle's polygon and its radius is tested edge by edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, cos, pi, radians, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geowarden.functions.geo import CIRCLE_STEPS, DEGREE_M, RADIUS_M, half_box
from geowarden.operators.cells import cell_size, in_cell, over_cells

#: Widths of a search box in a tile; least readings of a slab (with time, without), slabs that all readings are worth, most slabs of one tile.
TILE, LEAST, SHARES, SLABS = 32, (2_000, 200), 256, 64
#: Readings of a chunk at least and at most, those of a part of it that is tested at once, cells of its matrix, matches in a batch that leaves.
CHUNK_LEAST, CHUNK_MOST, PART, MATRIX, OUT = 256, 16_384, 64, 1 << 18, 1 << 20
FOREVER = np.iinfo(np.int64).max
KEYS = ["layer_id", "cell_y", "cell_x", "slab"]


@dataclass(frozen=True)
class Search:
    """``high``: half the height, in degrees, of the search box (None: all positions, wherever they are).

    ``shape`` and ``meters`` are the area that the other side's place has to lie in, around the
    reading or (``around_other``) the position; shape "any" has no test.  ``out`` is lists, counts or pairs.
    """

    high: float | None
    out: str
    shape: str | None = "any"
    meters: float = 0.0
    around_other: bool = False
    negated: bool = False
    same: bool = False
    timed: bool = True


def swept(asked: DataFrame, held: DataFrame, search: Search) -> DataFrame:
    """``row`` of every asked with ``refs`` (sorted), ``n``, or ``other_id, other_lat, other_lon``.

    asked: layer_id, device, lat, lon, half (of the search box's width), at, id, row; held: layer_id, device, lat, lon, at, id, until, until_id.
    """
    high = (0.0 if search.shape in (None, "any") else search.meters) / DEGREE_M
    inner = F.lit(high) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))
    asked, held = asked.withColumn("inner", inner), held.withColumn("inner", inner)
    if search.high is None:
        asked, held = (df.withColumn("cell_y", F.lit(0).cast("long")).withColumn("cell_x", F.lit(0).cast("long")) for df in (asked, held))
    else:
        size = cell_size(TILE * search.high * DEGREE_M)
        wide = F.least(half_box(F.least(F.abs("lat") + search.high, F.lit(90.0)), 1.0001 * search.high * DEGREE_M)[1], F.lit(180.0))
        asked = in_cell(asked, size)
        held = over_cells(held, size, F.col("lat") - 1.0001 * search.high, F.col("lon") - wide, F.col("lat") + 1.0001 * search.high, F.col("lon") + wide)
    asked, held, slabs = _cut(asked, held, search.timed)
    kind = asked.schema["row"].dataType
    columns = [*KEYS, "kind", "device", "lat", "lon", "half", "inner", "at", "id", "until", "until_id", "row"]
    none = lambda name, like: F.lit(None).cast(like).alias(name)
    readings = asked.select(*KEYS, F.lit(1).alias("kind"), "device", "lat", "lon", "half", "inner", "at", "id", none("until", "long"), none("until_id", asked.schema["id"].dataType), "row")
    positions = held.select(*KEYS, F.lit(0).alias("kind"), "device", "lat", "lon", none("half", "double"), "inner", "at", "id", "until", "until_id", none("row", kind))
    spark = asked.sparkSession
    parts = min(1_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * slabs))
    both = readings.unionByName(positions).repartition(parts, *KEYS)
    both = both.sortWithinPartitions(*KEYS, "kind", F.when(F.col("kind") == 0, F.col("device")), "at", "id").select(*columns)
    found = {"lists": [T.StructField("refs", T.ArrayType(held.schema["device"].dataType))], "counts": [T.StructField("n", T.LongType())],
             "pairs": [T.StructField("other_id", held.schema["device"].dataType), T.StructField("other_lat", T.DoubleType()), T.StructField("other_lon", T.DoubleType())]}[search.out]
    return both.mapInArrow(_Sweep(search), T.StructType([T.StructField("row", kind), *found]))


def _cut(asked: DataFrame, held: DataFrame, timed: bool) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with their ``slab``, and how many slabs hot tiles have: parts of time of about as many readings each, or parts of readings where time plays no role."""
    tile = KEYS[:3]
    count = asked.groupBy(*tile).agg(F.count("*").alias("n"), *([F.percentile_approx("at", [k / SLABS for k in range(1, SLABS)], 1_000).alias("marks")] if timed else []))
    least, hot, slabs = LEAST[0 if timed else 1], [], 0
    rows = count.filter(F.col("n") > least).collect()
    least = max(least, sum(r["n"] for r in rows) / SHARES)
    for r in rows:
        n = min(SLABS, ceil(r["n"] / least))
        edges = sorted({r["marks"][k * SLABS // n - 1] for k in range(1, n)}) if timed else list(range(1, n))
        if edges:
            slabs += len(edges) + 1
            hot.append((*(r[k] for k in tile), edges))
    if not hot:
        none = F.lit(0).cast("int")
        return asked.withColumn("slab", none), held.withColumn("slab", none), 0
    cuts = F.broadcast(asked.sparkSession.createDataFrame(hot, T.StructType([*[asked.schema[k] for k in tile], T.StructField("edges", T.ArrayType(T.LongType()))])))
    edges = F.coalesce("edges", F.array().cast("array<long>"))
    upto = lambda c: F.size(F.filter(edges, lambda e: e <= F.col(c)))
    asked, held = asked.join(cuts, tile, "left"), held.join(cuts, tile, "left")
    if timed:
        last = F.when(F.col("until").isNull(), F.size(edges)).otherwise(upto("until"))
        first = upto("at")
        mine = upto("at")
    else:
        first, last = F.lit(0), F.size(edges)
        mine = F.pmod(F.xxhash64("id", "lat", "lon"), F.size(edges) + 1).cast("int")
    return asked.withColumn("slab", mine).drop("edges"), held.withColumn("slab", F.explode(F.sequence(first, last))).drop("edges"), slabs


def _values(column: pa.Array, null: object) -> np.ndarray:
    """Numbers as they are, texts as fixed-width ones: both compare as Spark does."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return pc.fill_null(column, null).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy(zero_copy_only=False)
    return np.array([x or "" for x in column.to_pylist()], dtype=str)


def ring(lat: np.ndarray, lon: np.ndarray, meters: float) -> tuple[np.ndarray, np.ndarray]:
    """Corners of geo.circle_area: latitudes and longitudes, one row a place."""
    d, p = meters / RADIUS_M, np.radians(lat)[:, None]
    b = [radians(-360 * k / CIRCLE_STEPS) for k in range(CIRCLE_STEPS)]
    y = np.arcsin(np.sin(p) * cos(d) + np.cos(p) * np.array([sin(d) * cos(x) for x in b]))
    x = np.radians(lon)[:, None] + np.arctan2(np.cos(p) * np.array([sin(x) * sin(d) for x in b]), cos(d) - np.sin(p) * np.sin(y))
    return np.degrees(y), np.degrees(x)


def inside(y: np.ndarray, x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """geo._inside for one place a row: even-odd, borders included."""
    y, x, y1, x1, y2, x2 = y[:, None], x[:, None], ys, xs, np.roll(ys, -1, 1), np.roll(xs, -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        crossing = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    border = (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2)) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0)
    return (crossing.sum(1) % 2 == 1) | border.any(1)


def in_circle(lat: np.ndarray, lon: np.ndarray, meters: float, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """geo.place_in for circles."""
    p, q = np.radians(lat), np.radians(y)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(x) - np.radians(lon)) / 2) ** 2
    d = 2 * RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    out = (d < 0.96 * meters) & (np.abs(lat) < 80)
    open_ = np.flatnonzero(~out & ~(d > 1.001 * meters))
    for k in range(0, len(open_), 20_000):
        at = open_[k : k + 20_000]
        out[at] = inside(y[at], x[at], *ring(lat[at], lon[at], meters))
    return out


class _Held:
    """The positions of a slab, ordered by device."""

    def __init__(self, parts: list[pa.RecordBatch], timed: bool) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        one = lambda name: rows[name].combine_chunks() if rows[name].num_chunks != 1 else rows[name].chunk(0)
        devices = pc.dictionary_encode(one("device"), null_encoding="encode")
        self.names, self.code = devices.dictionary, devices.indices.to_numpy(zero_copy_only=False)
        self.lat, self.lon, self.inner = (one(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "inner"))
        if timed:
            self.at, self.until = _values(one("at"), 0), _values(one("until"), FOREVER)
            self.id, self.until_id = _values(one("id"), 0), _values(one("until_id"), FOREVER)


class _Sweep:
    def __init__(self, search: Search) -> None:
        self.s = search

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, waiting, n = None, [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [pc.dictionary_encode(batch.column(KEYS[0]), null_encoding="encode").indices.to_numpy(), *(batch.column(k).to_numpy() for k in (*KEYS[1:], "kind"))]
            changed = np.zeros(batch.num_rows, bool)
            for k in keys:
                changed[1:] |= k[1:] != k[:-1]
            starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                now = (batch.column(KEYS[0])[lo].as_py(), *(int(k[lo]) for k in keys[1:4]))
                if now != key:
                    if waiting:
                        yield from self._chunk(held, waiting)
                    key, parts, held, waiting, n = now, [], None, [], 0
                if keys[4][lo] == 0:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if not parts:
                    continue
                if held is None:
                    held = _Held(parts, self.s.timed)
                    most = min(max(len(held.names) // 2, CHUNK_LEAST), CHUNK_MOST)
                while lo < hi:
                    take = min(hi - lo, most - n)
                    waiting.append(batch.slice(lo, take))
                    lo, n = lo + take, n + take
                    if n == most:
                        yield from self._chunk(held, waiting)
                        waiting, n = [], 0
        if waiting:
            yield from self._chunk(held, waiting)

    def _chunk(self, held: _Held, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Readings in the order of time against the positions that any of them can see."""
        s = self.s
        table = pa.Table.from_batches(parts).combine_chunks()
        one = lambda name: table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)
        n = table.num_rows
        lat, lon, inner = (one(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "inner"))
        half = one("half").to_numpy(zero_copy_only=False)
        own = None if s.same else pc.fill_null(pc.index_in(one("device"), value_set=held.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if s.timed:
            now, ids = _values(one("at"), 0), _values(one("id"), 0)
            begun = lambda t, i: (held.at < t) | (held.at == t) & (held.id < i)
            lasts = lambda t, i: (held.until > t) | (held.until == t) & (held.until_id >= i)
            seen = begun(now[-1], ids[-1]) & lasts(now[0], ids[0])
            chosen = np.flatnonzero(seen)
            moving = ~(begun(now[0], ids[0]) & lasts(now[-1], ids[-1]))[chosen]
            start, end = np.zeros(len(chosen), np.int64), np.full(len(chosen), n)
            m = chosen[moving]
            start[moving] = _upto(now, ids, held.at[m], held.id[m])
            end[moving] = np.where(held.until[m] == FOREVER, n, _upto(now, ids, held.until[m], held.until_id[m]))
        else:
            chosen = np.arange(len(held.code))
            moving, start, end = np.zeros(len(chosen), bool), np.zeros(len(chosen), np.int64), np.full(len(chosen), n)
        if not len(chosen):
            return
        away = float(np.abs(lon - lon[0]).max())
        olon = held.lon[chosen]
        olon = olon + 360.0 * np.rint((lon[0] - olon) / 360.0)
        wrap = not (float(np.abs(olon - lon[0]).max()) + away < 180 or s.high is not None and float(half.max()) + away < 179)
        c = _Columns(held.code[chosen], held.lat[chosen], held.lon[chosen], olon, held.inner[chosen], moving, start, end)
        r = _Rows(lat, lon, half, inner, own)
        out = _Out(s.out, one("row"), held.names, r, c)
        for rows, cols in self._places(r, c, wrap):
            if s.out == "counts" and s.high is not None and not wrap:
                cols = self._sure(r, c, rows, cols, out, n)
            step = max(1, MATRIX // max(1, len(cols)))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                if len(cols):
                    out.add(some, cols, self._test(r, c, some, cols, wrap))
                if out.n >= OUT:
                    yield out.batch()
            if s.out == "counts":
                out.close(rows)
        if out.n:
            yield out.batch()

    def _places(self, r: _Rows, c: _Columns, wrap: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Readings that are close together with the positions in their common box."""
        n, s = len(r.lat), self.s
        k = 1 if s.high is None or wrap else max(1, int((n / PART) ** 0.5))
        if k == 1 and (s.high is None or wrap):
            yield np.arange(n), np.arange(len(c.code))
            return
        part = lambda v: np.minimum(((v - v.min()) * (k / max(v.max() - v.min(), 1e-12))).astype(int), k - 1)
        ky, kx = part(r.lat), part(r.lon)
        slack = 1e-9
        for y in np.unique(ky):
            line = np.flatnonzero(ky == y)
            near = np.flatnonzero((c.lat >= r.lat[line].min() - s.high - slack) & (c.lat <= r.lat[line].max() + s.high + slack))
            lons, xs = c.lon[near], kx[line]
            for x in np.unique(xs):
                rows = line[xs == x]
                at = r.lon[rows]
                wide = float(r.half[rows].max()) + slack
                yield rows, near[(lons >= at.min() - wide) & (lons <= at.max() + wide)]

    def _sure(self, r: _Rows, c: _Columns, rows: np.ndarray, cols: np.ndarray, out: _Out, n: int) -> np.ndarray:
        """Counts, without looking at pairs, positions that match from all of the rows' places; what is left of ``cols``."""
        s = self.s
        lat, lon, y, x = r.lat[rows], r.lon[rows], c.lat[cols], c.lon[cols]
        far_y, far_x = np.maximum(np.abs(y - lat.min()), np.abs(y - lat.max())), np.maximum(np.abs(x - lon.min()), np.abs(x - lon.max()))
        less, more = 1 - 1e-9, 1 + 1e-9
        sure = (far_y < less * s.high) & (far_x < less * r.half[rows].min())
        high = s.meters / DEGREE_M
        if s.shape != "any":
            if s.around_other or s.shape is None or s.meters <= 0 or s.shape == "radius" and (not s.negated or np.abs(lat).max() >= 60):
                return cols
            if s.negated:
                near_y, near_x = np.maximum(y - lat.max(), lat.min() - y), np.maximum(x - lon.max(), lon.min() - x)
                more = more if s.shape == "bbox" else 1.01 + 4 * s.meters / RADIUS_M
                sure &= (near_y > more * high) | (near_x > more * r.inner[rows].max())
            else:
                sure &= (far_y < less * high) & (far_x < less * r.inner[rows].min())
        sure = cols[sure]
        if not len(sure):
            return cols
        change = np.bincount(c.start[sure], minlength=n + 1) - np.bincount(c.end[sure], minlength=n + 1)[: n + 1]
        out.counts[rows] += np.cumsum(change)[rows]
        if r.own is not None:
            # Of these, the ones a reading's own device holds at its time.
            order = np.argsort(r.own[rows] * (n + 1) + rows, kind="stable")
            keys = (r.own[rows] * (n + 1) + rows)[order]
            code = c.code[sure].astype(np.int64) * (n + 1)
            first, last = np.searchsorted(keys, code + c.start[sure]), np.searchsorted(keys, code + np.minimum(c.end[sure], n))
            change = np.bincount(first, minlength=len(keys) + 1) - np.bincount(last, minlength=len(keys) + 1)
            out.counts[rows[order]] -= np.cumsum(change)[:-1]
        return np.setdiff1d(cols, sure, assume_unique=True)

    def _test(self, r: _Rows, c: _Columns, rows: np.ndarray, cols: np.ndarray, wrap: bool) -> np.ndarray:
        s, found = self.s, None
        y, x = c.lat[cols][None, :], c.lon[cols][None, :]
        lat, lon = r.lat[rows][:, None], r.lon[rows][:, None]
        if s.shape == "any" and s.high is None:
            found = np.ones((len(rows), len(cols)), bool)
        elif s.shape == "any" and not s.timed and not wrap:
            half = r.half[rows][:, None]  # a search: its box has edges
            found = y >= lat - s.high
            found &= y <= lat + s.high
            found &= x >= lon - half
            found &= x <= lon + half
        else:
            dy, dx = y - lat, x - lon
            if wrap:
                dx -= 360.0 * np.rint(dx / 360.0)
            np.abs(dy, out=dy), np.abs(dx, out=dx)
            boxed = None
            same_box = s.shape in ("bbox", "radius") and not s.around_other and not s.negated and s.high == s.meters / DEGREE_M and bool((r.half[rows] == r.inner[rows]).all())
            if s.high is not None and not same_box:
                boxed = dy <= s.high
                boxed &= dx <= r.half[rows][:, None]
            if s.shape == "any":
                found = boxed
            else:
                found = self._held(r, c, rows, cols, dy, dx, boxed, same_box)
                if s.negated:
                    np.logical_not(found, out=found)
                if boxed is not None:
                    found &= boxed
        moves = np.flatnonzero(c.moving[cols])
        if len(moves):
            m = cols[moves]
            found[:, moves] &= (c.start[m][None, :] <= rows[:, None]) & (rows[:, None] < c.end[m][None, :])
        if r.own is not None:
            code = c.code[cols]
            first, last = np.searchsorted(code, r.own[rows]), np.searchsorted(code, r.own[rows], "right")
            for i in np.flatnonzero(last > first):
                found[i, first[i] : last[i]] = False
        return found

    def _held(self, r: _Rows, c: _Columns, rows: np.ndarray, cols: np.ndarray, dy: np.ndarray, dx: np.ndarray, boxed: np.ndarray | None, same_box: bool) -> np.ndarray:
        """The place lies in the area: plain arithmetic unless the area is a circle."""
        s = self.s
        if s.shape is None or s.meters <= 0:
            return (dy == 0) & (dx == 0)
        high = s.meters / DEGREE_M
        inner = c.inner[cols][None, :] if s.around_other else r.inner[rows][:, None]
        if s.shape == "bbox":
            found = dy <= high
            found &= dx <= inner
            return found
        # A regular 12-gon holds all within cos(15 degrees) of its radius and nothing beyond it; degrees scaled
        # at its centre are off by less than their share of the earth's radius below 60 degrees of latitude.
        off = 0.002 + 4 * s.meters / RADIUS_M
        u = (dy / high) ** 2 + (dx / inner) ** 2
        level = np.abs(c.lat[cols] if s.around_other else r.lat[rows]) < 60
        level = level[None, :] if s.around_other else level[:, None]
        found = (u < (cos(pi / CIRCLE_STEPS) * (1 - off)) ** 2) & level
        open_ = ~found & ((u <= (1 + off) ** 2) | ~level)
        if boxed is not None:
            open_ &= boxed
        i, j = np.nonzero(open_)
        if len(i):
            lat, lon = r.lat[rows[i]], r.lon[rows[i]]
            y, x = c.lat[cols[j]], c.true_lon[cols[j]]
            x = x + 360.0 * np.rint((lon - x) / 360.0)
            some = in_circle(y, x, s.meters, lat, lon) if s.around_other else in_circle(lat, lon, s.meters, y, x)
            if same_box:
                some &= (dy[i, j] <= s.high) & (dx[i, j] <= r.half[rows[i]])
            found[i, j] = some
        return found


@dataclass
class _Rows:
    lat: np.ndarray
    lon: np.ndarray
    half: np.ndarray
    inner: np.ndarray
    own: np.ndarray | None


@dataclass
class _Columns:
    code: np.ndarray
    lat: np.ndarray
    true_lon: np.ndarray
    lon: np.ndarray
    inner: np.ndarray
    moving: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _upto(now: np.ndarray, ids: np.ndarray, at: np.ndarray, at_id: np.ndarray) -> np.ndarray:
    """How many readings (in the order of now, ids) are not after each moment."""
    n = len(now)
    t, i = np.concatenate([now, at]), np.concatenate([ids, at_id])
    order = np.lexsort((np.repeat([0, 1], [n, len(at)]), i, t))
    before = np.cumsum(order < n)
    out = np.empty(len(at), np.int64)
    late = order >= n
    out[order[late] - n] = before[late]
    return out


class _Out:
    """Matches of a chunk until they leave."""

    def __init__(self, kind: str, row: pa.Array, names: pa.Array, r: _Rows, c: _Columns) -> None:
        self.kind, self.row, self.names, self.r, self.c, self.n = kind, row, names, r, c, 0
        self.rows, self.many, self.cols = [], [], []
        self.counts = np.zeros(len(row), np.int64)

    def add(self, rows: np.ndarray, cols: np.ndarray, found: np.ndarray) -> None:
        many = np.count_nonzero(found, axis=1)
        if self.kind == "counts":
            self.counts[rows] += many
            return
        flat = np.flatnonzero(found)
        if not len(flat):
            return
        flat -= np.repeat(np.arange(len(rows)) * len(cols), many)
        self.rows.append(rows), self.many.append(many), self.cols.append(cols[flat])
        self.n += len(flat)

    def close(self, rows: np.ndarray) -> None:
        some = rows[self.counts[rows] > 0]
        self.rows.append(some)
        self.n += len(some)

    def batch(self) -> pa.RecordBatch:
        rows = np.concatenate(self.rows)
        if self.kind == "counts":
            out = pa.RecordBatch.from_arrays([self.row.take(pa.array(rows)), pa.array(self.counts[rows])], names=["row", "n"])
        else:
            many, cols = np.concatenate(self.many), np.concatenate(self.cols)
            refs = self.names.take(pa.array(self.c.code[cols]))
            if self.kind == "lists":
                some = many > 0
                offsets = np.concatenate([[0], np.cumsum(many[some])]).astype(np.int32)
                out = pa.RecordBatch.from_arrays([self.row.take(pa.array(rows[some])), pa.ListArray.from_arrays(pa.array(offsets), refs)], names=["row", "refs"])
            else:
                at = np.repeat(rows, many)
                lon = self.c.true_lon[cols]
                lon = lon + 360.0 * np.rint((self.r.lon[at] - lon) / 360.0)
                out = pa.RecordBatch.from_arrays([self.row.take(pa.array(at)), refs, pa.array(self.c.lat[cols]), pa.array(lon)], names=["row", "other_id", "other_lat", "other_lon"])
        self.rows, self.many, self.cols, self.n = [], [], [], 0
        return out
