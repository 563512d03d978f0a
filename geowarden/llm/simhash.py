"""SimHash near-duplicates: positional bytes, count filtering, exact verification.

A fingerprint has eight positional bytes.  Two that differ in at most two bits share at least six
of them, and so share both bytes of at least two of the four neighbouring byte pairs.  The
inverted index therefore files a fingerprint under the six intersections of two byte pairs (four
positional bytes each), which is the filter by count of shared pairs worked into the lists: those
under single bytes would hold N/256 entries each and emit N*N/64 pairs.  For each pair that meets,
the shared positional bytes are tallied, pairs below the guaranteed six are dropped, and the rest
is verified by its differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, durable, keep_least, row_keys, slices, tidy
from .components import components

BITS = 2
SHARED = 6
#: Longest list that is joined with itself; longer ones take the other exact way of links().
LIST = 1000
_PAIRS = list(combinations(range(4), 2))
_LANES = np.uint64(0x0101010101010101)
_FOLD = 255


def _hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every word shingle of a lower-cased text, in bounded pieces."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = starts + sizes
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    for at in range(0, len(starts), 1 << 16):
        cut = map(slice, starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(42)), dtype=np.uint64, count=len(starts[at : at + (1 << 16)]))


def _fold(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits by position (64 columns) of every run of ``hashes`` that begins at ``starts``."""
    ends = np.concatenate((starts[1:], [len(hashes)]))
    n = -(-(ends - starts) // _FOLD)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    cuts = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(first, n)) * _FOLD
    out = np.empty((len(starts), 64), dtype=np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        out[:, bit::8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    return out


def fingerprints_of(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """The fingerprint of every text as a signed 64-bit integer; 0 where there is no word."""
    found = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    some: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if some:
            sizes = np.fromiter(map(len, some), dtype=np.int64)
            np.add.at(found, owners, _fold(np.concatenate(some), np.concatenate(([0], np.cumsum(sizes)[:-1]))))
            np.add.at(total, owners, sizes)
            some.clear()
            owners.clear()

    for k, text in enumerate(texts):
        for part in _hashes(text or b"", width):
            some.append(part)
            owners.append(k)
            if len(part) == 1 << 16 or len(some) >= 2000:
                flush()
    flush()
    bits = (2 * found > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints_of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of every set of hashes as a signed 64-bit integer; 0 where it is empty."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    bits = np.zeros((len(sets), 64), dtype=np.uint8)
    some = np.flatnonzero(sizes)
    if len(some):
        found = _fold(np.concatenate([sets[k] for k in some]), np.cumsum(sizes[some]) - sizes[some])
        bits[some] = 2 * found > sizes[some, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", keys: list[Column] | None = None) -> DataFrame:
    """``doc_id, fp`` and the ``keys`` (_k1, _k2) for each row; a null or wordless text has fingerprint 0, a null doc_id stays null."""
    names = ["_k1", "_k2"] if keys else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints_of(piece.column(1).to_pylist(), width)), *piece.columns[2:]], ["doc_id", "fp", *names])

    return docs.select(F.col("doc_id").cast("long"), body(text).alias("_text"), *(keys or [])).mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ["doc_id", "fp", *names]))


def _blocks(fp: str) -> list[Column]:
    return [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF) for k in range(4)]


def _tally(a: str, b: str) -> Column:
    """Positional bytes that two fingerprints share."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return reduce(lambda p, q: p + q, [(F.shiftrightunsigned(x, 8 * k).bitwiseAND(0xFF) == 0).cast("int") for k in range(8)])


def _verified(pairs: DataFrame, bits: int) -> DataFrame:
    shared = 8 - bits
    return pairs.filter(_tally("a", "b") >= shared).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def links(distinct: DataFrame, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """``a, b`` (a < b): the pairs of distinct fingerprints ``fp`` that differ in at most ``bits`` (2 or fewer) bits.

    Lists of over ``longest`` members are not joined with themselves.  Their members agree in 32
    bits; each is filed under the 33 words within one bit of its other 32, two within two bits
    meet under one of them, and at most 33 distinct fingerprints share a word.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees shared bytes for up to two differing bits")
    q = _blocks("fp")
    filed = F.array(*[F.struct((F.lit(n << 32).cast("long") + F.shiftleft(q[i], 16) + q[j]).alias("key"), (F.shiftleft(q[[k for k in range(4) if k not in (i, j)][0]], 16) + q[[k for k in range(4) if k not in (i, j)][1]]).alias("rest")) for n, (i, j) in enumerate(_PAIRS)])
    index = durable(distinct.select("fp", F.explode(filed).alias("e")).select("fp", "e.key", "e.rest"))
    long = index.groupBy("key").count().filter(F.col("count") > longest).select("key")
    hot, short = index.join(long, "key", "left_semi"), index.join(long, "key", "left_anti")
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    cold = _verified(a.join(b, "key").filter("a < b"), bits).select("a", "b")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    near = hot.select("key", "fp", "rest", F.explode(masks).alias("mask")).select("key", "fp", F.col("rest").bitwiseXOR(F.col("mask")).alias("word"))
    x, y = near.select("key", "word", F.col("fp").alias("a")), near.select("key", "word", F.col("fp").alias("b"))
    warm = _verified(x.join(y, ["key", "word"]).filter("a < b"), bits).select("a", "b")
    return cold.union(warm).distinct()


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = BITS, text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    Rows of one fingerprint form a class, so copies are never expanded into pairs; classes are
    linked, and component_id is the smallest doc_id of all classes that are reachable.  Null and
    wordless texts have fingerprint 0 and are linked like any other; rows with a null doc_id keep
    it and take part; repeated rows give repeated rows; an empty table gives none; other columns
    are not looked at.
    """
    rows = durable(fingerprints(docs, width, text))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    root = components(links(classes.select("fp"), bits), "a", "b")
    named = classes.join(root, classes["fp"] == root["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = durable(named.join(lowest, "root").filter((F.col("n") > 1) | (F.col("root") != F.col("fp")) | (F.col("component_id") != F.col("least"))).select("fp", "component_id"))
    return rows.join(known, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, bits: int = BITS, text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, all columns: the one with the smallest doc_id, nulls last; of rows that are repeated whole one stays."""
    rows = durable(fingerprints(docs, width, text, row_keys(docs)))
    root = components(links(rows.select("fp").distinct(), bits), "a", "b")
    return keep_least(docs, rows.join(root, rows["fp"] == root["node"], "left").select("doc_id", "_k1", "_k2", F.coalesce("root", "fp").alias("group")))
