"""Repeated passages by fixed-block anchors.

Texts are cut into aligned blocks of ``block`` words, ``block`` being small enough that every window
of ``window`` words holds a whole one.  The blocks are the index; every rolling run of as many
words probes it.  A window that occurs twice therefore holds a block that is found elsewhere, so
only the windows around found blocks are left; these are compared in full by a 96-bit hash over
all their words, and overlapping survivors form the maximal repeats.

Texts move once, to ``part`` groups of bounded size (by doc_id and text, so hot sources or copies
spread).  What else moves is bytes per word, not rows: a part sends, for each range of hash
values, the sorted distinct values it holds (32-bit gaps) with a bit for "is a block here" and
one for "occurs more than once here", and gets back the values that count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, resident, text_bytes, trim

WINDOW = 35
#: Text bytes of a part, and values that one range of hashes holds, about.
PART_BYTES = 8 << 20
RANGE_VALUES = 2_000_000
_B1, _B2, _B3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BITS = np.uint64(48)


def _rolling(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of every run of ``width`` values."""
    out = np.zeros(max(0, len(values) - width + 1), dtype=np.uint64)
    for k in range(width):
        out *= base
        out += values[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ out >> np.uint64(32)


class _Part:
    """The words of a group of texts as hashes, one after the other."""

    def __init__(self, texts: list[bytes | None]) -> None:
        each = [np.fromiter(map(xxhash.xxh64_intdigest, ws, repeat(7)), dtype=np.uint64, count=len(ws)) for ws in map(bytes.split, (t or b"" for t in texts))]
        self.n = np.fromiter(map(len, each), dtype=np.int64, count=len(texts))
        self.hash = np.concatenate([np.empty(0, dtype=np.uint64), *each])
        self.start = np.concatenate(([0], np.cumsum(self.n))).astype(np.int64)

    def inside(self, width: int) -> np.ndarray:
        """Whether a run of ``width`` words that begins here stays in its text."""
        ok = np.ones(max(0, len(self.hash) - width + 1), dtype=bool)
        for end in self.start[1:-1]:
            ok[max(0, end - width + 1) : end] = False
        return ok

    def blocks(self, block: int) -> np.ndarray:
        """Where aligned blocks begin."""
        lists = [np.arange(s, s + n - block + 1, block) for s, n in zip(self.start[:-1], self.n, strict=True) if n >= block]
        return np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> (np.uint64(64) - _BITS)


def _gaps(values: np.ndarray) -> bytes:
    """Sorted distinct values as 32-bit gaps where they fit, else as they are."""
    gaps = np.diff(values, prepend=np.uint64(0))
    wide = bool((gaps[1:] >> np.uint64(32)).any())
    return bytes([wide]) + (values.tobytes() if wide else values[:1].tobytes() + gaps[1:].astype(np.uint32).tobytes())


def _values(raw: bytes) -> np.ndarray:
    if raw[0]:
        return np.frombuffer(raw, dtype=np.uint64, offset=1)
    gaps = np.concatenate((np.frombuffer(raw, dtype=np.uint64, offset=1, count=1), np.frombuffer(raw, dtype=np.uint32, offset=9).astype(np.uint64)))
    return np.cumsum(gaps, dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _candidates(part: _Part, found: np.ndarray, window: int, block: int) -> np.ndarray:
    """Where the windows begin whose first aligned block is among ``found`` (sorted short hashes)."""
    at = part.blocks(block)
    at = at[_among(_short(_rolling(part.hash, block, _B1)[at]), found)] if len(at) else at
    mark = np.zeros(len(part.hash) + 1, dtype=np.int64)
    owner = np.searchsorted(part.start, at, side="right") - 1
    np.add.at(mark, np.maximum(at - (window - block), part.start[owner]), 1)
    np.add.at(mark, np.maximum(np.minimum(at + 1, part.start[owner + 1] - window + 1), np.maximum(at - (window - block), part.start[owner])), -1)
    return np.flatnonzero(np.cumsum(mark)[:-1] > 0)


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), dtype=bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


_FULL = np.dtype([("a", "<u8"), ("b", "<u4")])


def _full(part: _Part, at: np.ndarray, window: int) -> np.ndarray:
    """96-bit hashes of the windows that begin at ``at``."""
    out = np.empty(len(at), dtype=_FULL)
    if len(at):
        out["a"] = _rolling(part.hash, window, _B2)[at]
        out["b"] = (_rolling(part.hash, window, _B3)[at] >> np.uint64(32)).astype(np.uint32)
    return out


def _distinct(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often each occurs."""
    s = full[np.lexsort((full["b"], full["a"]))]
    if not len(s):
        return s, np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.diff(np.append(first, len(s)))


def _ranged(high: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Range number and slice of every stretch of sorted values with the same leading bits."""
    if len(high):
        cut = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
        yield from zip(high[cut].tolist(), cut.tolist(), np.append(cut[1:], len(high)).tolist(), strict=True)


def _anchors(window: int, block: int, bits: int):
    def send(group: pa.Table) -> pa.Table:
        resident()
        trim()
        part = _Part(group.column("text").to_pylist())
        number = group.column("part")[0].as_py()
        rows: dict[str, list] = {"part": [], "bin": [], "probes": [], "n": [], "is_block": [], "again": []}
        h = _short(_rolling(part.hash, block, _B1))
        values, count = np.unique(h[part.inside(block)], return_counts=True)
        own = _among(values, np.unique(h[part.blocks(block)]))
        for k, a, b in _ranged(values >> np.uint64(int(_BITS) - bits)):
            for name, x in (("part", number), ("bin", k), ("probes", _gaps(values[a:b])), ("n", b - a), ("is_block", _bits(own[a:b])), ("again", _bits(count[a:b] > 1))):
                rows[name].append(x)
        return pa.table(rows, schema=pa.schema([("part", pa.int64()), ("bin", pa.int64()), ("probes", pa.binary()), ("n", pa.int32()), ("is_block", pa.binary()), ("again", pa.binary())]))

    return send, "part long, bin long, probes binary, n int, is_block binary, again binary"


def _probe(group: pa.Table) -> pa.Table:
    """The blocks of each part that occur anywhere else, for one range of hashes."""
    parts, n = group.column("part").to_pylist(), group.column("n").to_pylist()
    each = [_values(x) for x in group.column("probes").to_pylist()]
    every = np.concatenate(each)
    again = np.concatenate([_flags(x, k) for x, k in zip(group.column("again").to_pylist(), n, strict=True)])
    order = np.argsort(every, kind="stable")
    s = every[order]
    shared = np.zeros(len(s), dtype=bool)
    shared[1:] = s[1:] == s[:-1]
    shared[:-1] |= shared[1:]
    found = np.empty(len(s), dtype=bool)
    found[order] = shared
    found |= again
    found &= np.concatenate([_flags(x, k) for x, k in zip(group.column("is_block").to_pylist(), n, strict=True)])
    out_part, out = [], []
    for p, a, b in zip(parts, np.cumsum([0, *n[:-1]]).tolist(), np.cumsum(n).tolist(), strict=True):
        if found[a:b].any():
            out_part.append(p)
            out.append(every[a:b][found[a:b]].tobytes())
    return pa.table({"part": pa.array(out_part, pa.int64()), "found": pa.array(out, pa.binary())})


def _hits(group: pa.Table) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(group.column("found").to_pylist()), dtype=np.uint64))


def _windows(window: int, block: int, bits: int):
    def send(texts: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        rows: dict[str, list] = {"part": [], "bin": [], "full": [], "again": []}
        if texts.num_rows and found.num_rows:
            part = _Part(texts.column("text").to_pylist())
            number = texts.column("part")[0].as_py()
            full, count = _distinct(_full(part, _candidates(part, _hits(found), window, block), window))
            for k, a, b in _ranged(full["a"] >> np.uint64(64 - bits)):
                for name, x in (("part", number), ("bin", k), ("full", full[a:b].tobytes()), ("again", _bits(count[a:b] > 1))):
                    rows[name].append(x)
        return pa.table(rows, schema=pa.schema([("part", pa.int64()), ("bin", pa.int64()), ("full", pa.binary()), ("again", pa.binary())]))

    return send, "part long, bin long, full binary, again binary"


def _verify(group: pa.Table) -> pa.Table:
    """The windows of each part that begin anywhere else too, for one range of hashes."""
    each = [np.frombuffer(x, dtype=_FULL) for x in group.column("full").to_pylist()]
    again = np.concatenate([_flags(x, len(f)) for x, f in zip(group.column("again").to_pylist(), each, strict=True)])
    every = np.concatenate(each)
    order = np.lexsort((every["b"], every["a"]))
    s = every[order]
    shared = np.zeros(len(s), dtype=bool)
    shared[1:] = s[1:] == s[:-1]
    shared[:-1] |= shared[1:]
    found = np.empty(len(s), dtype=bool)
    found[order] = shared
    found |= again
    out_part, out, at = [], [], 0
    for p, f in zip(group.column("part").to_pylist(), each, strict=True):
        if found[at : at + len(f)].any():
            out_part.append(p)
            out.append(f[found[at : at + len(f)]].tobytes())
        at += len(f)
    return pa.table({"part": pa.array(out_part, pa.int64()), "found": pa.array(out, pa.binary())})


def _covered(part: _Part, at: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window that begins at one of ``at``."""
    mark = np.zeros(len(part.hash) + 1, dtype=np.int64)
    mark[at] += 1
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark)[:-1] > 0


def _cut(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space after them."""
    out, at, keep = [], 0, 0
    for w, x in zip(words, gone.tolist(), strict=True):
        begin = text.index(w, at)
        if x and keep is not None:
            out.append(text[keep:begin])
            keep = None
        elif not x and keep is None:
            keep = begin
        at = begin + len(w)
    if keep is not None:
        out.append(text[keep:])
    return b"".join(out)


def _removal(window: int, block: int, want: str):
    def remove(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        if not texts.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"row": texts.column("row").slice(0, 0), "n_words": none, "n_removed": none, want: pa.array([], pa.string())})
        trim()
        raw = texts.column("text").to_pylist()
        part = _Part(raw)
        gone = np.zeros(len(part.hash), dtype=bool)
        if repeats.num_rows:
            full, _ = _distinct(np.frombuffer(b"".join(repeats.column("found").to_pylist()), dtype=_FULL))
            lead = _rolling(part.hash, window, _B2)
            at = np.flatnonzero(part.inside(window) & _among(lead, np.unique(full["a"])))
            mine = _full(part, at, window)
            # One of equal leading halves may differ in the other: compare whole hashes.
            both = np.concatenate((full, mine))
            order = np.lexsort((np.arange(len(both)) >= len(full), both["b"], both["a"]))
            s = both[order]
            group = np.cumsum(np.concatenate(([True], s[1:] != s[:-1])))
            listed = np.zeros(group[-1] + 1, dtype=bool)
            listed[group[order < len(full)]] = True
            ok = np.empty(len(both), dtype=bool)
            ok[order] = listed[group]
            gone = _covered(part, at[ok[len(full) :]], window)
        out, removed = [], []
        for t, a, n in zip(raw, part.start[:-1].tolist(), part.n.tolist(), strict=True):
            mine = gone[a : a + n]
            removed.append(int(mine.sum()))
            if want == "text":
                out.append(None if t is None else (_cut(t, t.split(), mine) if removed[-1] else t).decode(errors="replace"))
            else:
                ws = (t or b"").split()
                out.append(sha256(b" ".join([w for w, x in zip(ws, mine.tolist(), strict=True) if not x] if removed[-1] else ws)).hexdigest())
        return pa.table({"row": texts.column("row"), "n_words": pa.array(part.n), "n_removed": pa.array(removed, pa.int64()), want: pa.array(out, pa.string())})

    return remove, f"n_words long, n_removed long, {want} string"


def _placed(docs: DataFrame, row: Column, text: str, parts: int) -> DataFrame:
    """Texts by a hash of doc_id and whole text, so that neither a hot source nor a common header nor null ids fill a part."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.col(text).cast("string")), F.lit(parts))
    return docs.select(part.alias("part"), row.alias("row"), body(text).alias("text"))


def _removed(docs: DataFrame, row: Column, want: str, window: int, text: str, part_bytes: int, range_values: int) -> DataFrame:
    """``row, n_words, n_removed`` and the column ``want``."""
    if window < 1:
        raise ValueError("a window has one word at least")
    block = (window + 1) // 2
    total = text_bytes(docs, text)
    bits = max(1, (max(1, total // 6) // range_values).bit_length())
    placed = _placed(docs, row, text, max(1, -(-total // part_bytes)))
    send, schema = _anchors(window, block, bits)
    probes = placed.groupBy("part").applyInArrow(send, schema)
    found = probes.groupBy("bin").applyInArrow(_probe, "part long, found binary")
    send, schema = _windows(window, block, bits)
    candidates = placed.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(send, schema)
    repeats = candidates.groupBy("bin").applyInArrow(_verify, "part long, found binary")
    remove, schema = _removal(window, block, want)
    whole = T.StructType([placed.schema["row"], *T.StructType.fromDDL(schema).fields])
    return placed.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(remove, whole)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", part_bytes: int = PART_BYTES, range_values: int = RANGE_VALUES) -> DataFrame:
    """``docs`` without the words of repeated passages: all columns, ``text`` being what is left of it.

    A word goes if it lies in a window of ``window`` words whose words also begin anywhere else, in
    the same text included; all windows are judged on the input.  White space between kept words
    stays.  Null texts have no words and stay null; texts shorter than a window stay as they are;
    rows that repeat a doc_id are texts of their own; an empty table gives none; other columns may
    have any names.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text], F.lit(0).alias("any"))
    left = _removed(docs, row, "text", window, text, part_bytes, range_values)
    return left.select(*[(F.col("text") if c == text else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def repeat_digests(docs: DataFrame, window: int = WINDOW, text: str = "text", part_bytes: int = PART_BYTES, range_values: int = RANGE_VALUES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (of the kept words, a space between) for each row; cases as above."""
    return _removed(docs, F.col("doc_id").cast("long"), "kept_sha256", window, text, part_bytes, range_values).withColumnRenamed("row", "doc_id")
