"""Helpers shared by the operators: bounded batches, durable intermediate tables, sizing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from typing import Any
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes at a time.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share (``spark.checkpoint.dir``).

    One of our own only where none is set and all runs in one process, as in tests: a cluster has
    to name its folder, as a machine's own would lose data with the machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder: for texts, which it compresses."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder that the cluster names (``spark.checkpoint.dir``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_held: list[Any] = [None, None]


def trim() -> None:
    """Gives freed memory of a Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def resident(key: str | None = None, make: Callable[[], Any] | None = None) -> Any:
    """What a worker keeps between tasks: one operator's tables at a time, under ``key``; another key (or none) frees them."""
    if _held[0] != key:
        _held[:] = [None, None]
        trim()
        _held[:] = [key, make() if make else None]
    return _held[1]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that needs no tables: other operators' go first, and memory is given back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        yield from run(batches)
        trim()

    return wrapped


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the binary ``column`` of a piece holds about ``limit`` bytes (one row at least)."""
    ends = np.cumsum(sizes(batch.column(column)))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        done, at = int(ends[to - 1]), to


def sizes(values: pa.Array) -> np.ndarray:
    """Bytes of every value of a binary array; 0 for null."""
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], dtype=wide)[values.offset : values.offset + len(values) + 1]
    return np.diff(offsets).astype(np.int64)


def body(column: str = "text") -> Column:
    """The column's UTF-8 bytes, which Arrow then hands over without decoding."""
    return F.col(column).cast("binary")


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a row's columns (maps and variants left out); nulls count."""
    each = [F.col(f"`{f.name}`") for f in docs.schema if not {"map", "variant"} & set(f.dataType.simpleString().replace("<", " ").replace(":", " ").replace(",", " ").split())]
    flags = [c.isNull() for c in each]
    return [F.xxhash64(F.lit(k), *each, *flags).alias(f"_k{k}") for k in (1, 2)]


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``group`` of ``groups`` (doc_id, _k1, _k2, group): the one with the smallest doc_id, nulls last, ties by the keys."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).alias("row")
    kept = groups.groupBy("group").agg(least).select("row._k1", "row._k2")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys(docs))
    return keyed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row.*")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate of lengths, used to size partitions."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sql_words(text: str = "text") -> str:
    """DuckDB: the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
