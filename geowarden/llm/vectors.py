"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t.  They are rotated and split into
blocks of axes; a pair within that distance is within a block's share of it (in proportion to its
axes) in one block at least.  For every block vectors are range-joined: they fall into the cells
of a grid over the block's first axes, as wide as the block's radius, so partners lie in the same
cell or one beside it; cells are cut into chunks of bounded size, and a task compares two chunks.
Candidates are verified by their exact cosine in double precision, and a pair counts in the first
block that proposes it, so nothing has to be deduplicated.  Tasks return a count and a root per
vector, not pairs.

The rotation is fitted on a bounded sample: principal axes, dealt to the blocks so that each
begins with some of the widest.  How many blocks and grid axes pay depends on the data, so the
cells of all OPTIONS are counted first, over all vectors, and the option that compares the fewest
pairs is taken.  One block compares no pair twice, so that is never more than all pairs; on vectors
spread evenly over the sphere it is what is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, tidy
from .components import components

COSINE = 0.9
#: Blocks and grid axes of each block that are weighed against each other.
OPTIONS = ((1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (4, 2), (8, 2))
#: Vectors of each length that the rotation is fitted on, about, and lengths that get a fitted one.
SAMPLE, LENGTHS = 10_000, 8
#: Vectors of a chunk, and rows of a tile of the comparison of two chunks.
CHUNK = 8192
TILE = 1024
#: Room for the rounding of stored rotated vectors.
SLACK = 1e-5


def _rotation(dim: int, sample: np.ndarray | None) -> np.ndarray:
    """Columns are the new axes, widest first: principal axes of a sample, or fixed random ones."""
    if sample is not None and len(sample) > 1:
        return np.linalg.eigh(np.cov(sample.T, bias=True).reshape(dim, dim))[1][:, ::-1]
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _axes(dim: int, blocks: int) -> list[np.ndarray]:
    """The rotated axes of each block: dealt to and fro, so that every block begins with wide ones."""
    m = max(1, min(blocks, dim))
    lap, at = np.divmod(np.arange(dim), m)
    at = np.where(lap % 2, m - 1 - at, at)
    return [np.flatnonzero(at == k) for k in range(m)]


def _budgets(dim: int, blocks: int, cosine: float) -> np.ndarray:
    return np.array([(2 - 2 * cosine) * len(a) / dim for a in _axes(dim, blocks)]) + SLACK


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _turning(turns: dict[int, np.ndarray]):
    """Rotated unit vectors, as bytes of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            turned: list[bytes | None] = [None] * len(raw)
            for dim in set(dims):
                at = [k for k, d in enumerate(dims) if d == dim]
                y = (_units([raw[k] for k in at], dim) @ (turns[dim] if dim in turns else _rotation(dim, None))).astype(np.float32)
                for k, a in zip(at, y, strict=True):
                    turned[k] = a.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(turned, pa.binary())], ["rep", "cls", "size", "n", "raw", "dim", "turned"])

    return run, "rep long, cls long, size long, n long, raw binary, dim int, turned binary"


def _grid(turned: list[bytes], dim: int, blocks: int, axes: int, cosine: float) -> list[np.ndarray]:
    """Cells of all vectors in each block."""
    y = np.frombuffer(b"".join(turned), dtype=np.float32).reshape(-1, dim)
    return [np.floor(y[:, a[:axes]] / (np.sqrt(w) * 1.001)).astype(np.int32) for a, w in zip(_axes(dim, blocks), _budgets(dim, blocks, cosine), strict=True)]


def _counting(options: tuple, cosine: float):
    """``option, dim, block, cell, n`` of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            dims, turned = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for dim in set(dims):
                mine = [t for d, t in zip(dims, turned, strict=True) if d == dim]
                for k, (blocks, axes) in enumerate(options):
                    for b, cells in enumerate(_grid(mine, dim, blocks, axes, cosine)):
                        some, n = np.unique(cells, axis=0, return_counts=True)
                        out += [(k, dim, b, c, x) for c, x in zip(some.tolist(), n.tolist(), strict=True)]
            columns = list(zip(*out, strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.int64())], ["option", "dim", "block", "cell", "n"])

    return run, "option int, dim int, block int, cell array<int>, n long"


def _placing(blocks: int, axes: int, cosine: float):
    """A row for each block of each vector, with its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, turned = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for dim in set(dims):
                at = pa.array([k for k, d in enumerate(dims) if d == dim], pa.int32())
                mine = batch.take(at)
                for b, cells in enumerate(_grid(mine.column(4).to_pylist(), dim, blocks, axes, cosine)):
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array([b] * len(cells), pa.int32()), pa.array(cells.tolist(), pa.list_(pa.int32()))], ["cls", "size", "raw", "dim", "turned", "block", "cell"])

    return run, "cls long, size long, raw binary, dim int, turned binary, block int, cell array<int>"


def _beside(cells: DataFrame, by: list[str], axes: int, carried: str) -> DataFrame:
    """Every cell with itself and those beside it, each pair once: ``cell, cell2`` and ``carried`` of both."""
    steps = [s for s in product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]
    moved = F.explode(F.array(*[F.array(*[(F.get("cell", F.lit(k)) + x).cast("int") for k, x in enumerate(s)]) for s in steps])).alias("cell2")
    other = cells.select(*by, F.col("cell").alias("cell2"), F.col(carried).alias(f"{carried}2"))
    return cells.select(*by, "cell", carried, moved).join(other, [*by, "cell2"])


def planned_pairs(ready: DataFrame, cosine: float, options: tuple = OPTIONS) -> list[float]:
    """Pairs that each option would compare, counted over all rows of ``dim, turned``."""
    count, schema = _counting(options, cosine)
    counts = durable(ready.select("dim", "turned").mapInArrow(tidy(count), schema).groupBy("option", "dim", "block", "cell").agg(F.sum("n").cast("double").alias("n")))
    found = [0.0] * len(options)
    for axes in {a for _, a in options}:
        mine = [k for k, (_, a) in enumerate(options) if a == axes]
        # A block of fewer axes than the grid has cells of fewer numbers; none of their places is null.
        pairs = _beside(counts.filter(F.col("option").isin(mine)).withColumn("cell", F.expr(f"transform(sequence(0, {axes - 1}), k -> coalesce(get(cell, k), 0))")), ["option", "dim", "block"], axes, "n")
        each = F.when(F.col("cell") == F.col("cell2"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2"))
        for r in pairs.groupBy("option").agg(F.sum(each).alias("pairs")).collect():
            found[r["option"]] = r["pairs"]
    return found


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dim = table.column("dim")[0].as_py()
    raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype=np.float64).reshape(-1, dim)
    turned = np.frombuffer(b"".join(table.column("turned").to_pylist()), dtype=np.float32).reshape(-1, dim)
    return *(table.column(c).to_numpy() for c in ("cls", "size")), raw, turned


def _compare(blocks: int, cosine: float, tile: int):
    def run(task: pa.Table) -> pa.Table:
        b, dim = task.column("block")[0].as_py(), task.column("dim")[0].as_py()
        cls, size, raw, turned = _read(task)
        side = task.column("side").to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        axes, budgets = _axes(dim, blocks), _budgets(dim, blocks, cosine)
        part = np.ascontiguousarray(turned[:, axes[b]])
        square = np.einsum("ij,ij->i", part, part)
        links, label = np.zeros(len(cls), dtype=np.int64), np.arange(len(cls))
        scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(left), tile):
            a = left[lo : lo + tile]
            near = part[a] @ part[right].T
            near *= -2
            near += square[a][:, None]
            near += square[right]
            i, j = np.nonzero(near <= budgets[b] + SLACK)
            i, j = a[i], right[j]
            apart = (side[i] != 2) | (i < j)
            i, j = i[apart], j[apart]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                gap = np.square(turned[p].astype(np.float64) - turned[q])
                within = np.stack([gap[:, axes[k]].sum(axis=1) <= budgets[k] for k in range(b + 1)], axis=1)
                first = within[:, b] & ~within[:, :b].any(axis=1)
                p, q = p[first], q[first]
                ok = np.einsum("ij,ij->i", scaled[p], scaled[q]) / (norm[p] * norm[q]) >= cosine
                found.append((p[ok], q[ok]))
        if found:
            p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            np.add.at(links, p, size[q])
            np.add.at(links, q, size[p])
            while True:
                before = label.copy()
                low = np.minimum(label[p], label[q])
                np.minimum.at(label, p, low)
                np.minimum.at(label, q, low)
                label = label[label]
                if (label == before).all():
                    break
        some = np.flatnonzero(links)
        return pa.table({"cls": cls[some], "links": links[some], "root": cls[label[some]]})

    return run, "cls long, links long, root long"


def _fitted(classes: DataFrame) -> dict[int, np.ndarray]:
    """Rotations of the most frequent lengths, each from about SAMPLE of its vectors, chosen by hash."""
    turns = {}
    for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect():
        share = max(1, r["count"] // SAMPLE)
        some = classes.filter((F.col("dim") == r["dim"]) & (F.pmod("cls", F.lit(share)) == 0)).select("raw").limit(3 * SAMPLE).toArrow()
        turns[r["dim"]] = _rotation(r["dim"], _units(some.column("raw").to_pylist(), r["dim"]) if some.num_rows else None)
    return turns


def vector_groups(vectors: DataFrame, cosine: float = COSINE, options: tuple = OPTIONS, chunk: int = CHUNK, tile: int = TILE, vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Equal vectors form a class, linked to each other and compared once.  Rows whose vector is null,
    empty, zero or holds nulls or non-finite numbers link with nothing, nor do vectors of different
    lengths.  Rows with a null vec_id are linked and counted like any other; their component_id is
    the smallest vec_id they reach, null if there is none (kept is true then, else false).  Rows
    that repeat a vec_id are vectors of their own.  An empty table gives no rows; other columns are
    not looked at.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the threshold has to be above 0 and at most 1")
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else (np.array(x, dtype=np.float64) + 0.0).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["vec_id", "raw"])

    rows = durable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v")).mapInArrow(pack, "vec_id long, raw binary"))
    good = rows.filter("raw is not null")
    classes = durable(good.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).select("rep", F.xxhash64("raw").alias("cls"), "size", F.lit(0).cast("long").alias("n"), "raw", (F.length("raw") / 8).cast("int").alias("dim")))
    turn, schema = _turning(_fitted(classes))
    ready = durable(classes.mapInArrow(tidy(turn), schema))
    planned = planned_pairs(ready, cosine, options)
    blocks, axes = options[int(np.argmin(planned))]
    place, schema = _placing(blocks, axes, cosine)
    placed = ready.select("cls", "size", "raw", "dim", "turned").mapInArrow(tidy(place), schema).withColumn("cell", F.expr(f"transform(sequence(0, {axes - 1}), k -> coalesce(get(cell, k), 0))"))
    where = ["dim", "block", "cell"]
    cells = durable(placed.groupBy(*where).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    pairs = _beside(cells, ["dim", "block"], axes, "chunks")
    pairs = pairs.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1))).filter("cell <> cell2 or c <= c2")
    same = (F.col("cell") == F.col("cell2")) & (F.col("c") == F.col("c2"))
    task = F.struct("dim", "block", "cell", "cell2", "c", "c2")
    sides = F.when(same, F.array(F.struct(F.lit(2).alias("side"), F.col("cell").alias("at"), F.col("c").alias("chunk")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("cell").alias("at"), F.col("c").alias("chunk")), F.struct(F.lit(1).alias("side"), F.col("cell2").alias("at"), F.col("c2").alias("chunk")))
    )
    tasks = pairs.select("dim", "block", task.alias("task"), F.explode(sides).alias("s")).select("dim", "block", "task", "s.side", F.col("s.at").alias("cell"), "s.chunk")
    chunked = placed.join(cells, where).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).drop("chunks")
    compare, schema = _compare(blocks, cosine, tile)
    found = durable(chunked.join(tasks, [*where, "chunk"]).groupBy("task").applyInArrow(compare, schema))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    root = components(found, "cls", "root")
    named = classes.select("rep", "cls", "size").join(root, F.col("cls") == F.col("node"), "left").select("rep", "cls", "size", F.coalesce("root", "cls").alias("root"))
    least = durable(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    known = named.join(least, "root").join(counts, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = good.withColumn("cls", F.xxhash64("raw")).join(known, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.filter("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
