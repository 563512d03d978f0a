"""Near copies by word shingles: SimHash's positional bytes, then prefixes for what these can't promise; exact verification.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.  The
sets' 64-bit SimHash fingerprints go through the index of positional bytes, the count of shared
bytes and the test of differing bits of simhash.links(); what it links is verified on the sets.
That is not the whole, as similar sets differ in up to 11 and more bits, so a second inverted
index finds the rest, with the same steps over shingles in place of bytes.  If the shingles of every text are put in one order, two such texts share one of the first
n - ceil(0.8 n) + 1 of each.  Any order will do: shingles that are common in a sample come last,
so that few texts meet under notices and lines that many have.  The index moves as packed columns,
one row for each part of a task and range of shingles; only shingles that two different sets have
leave it as rows.  Shared shingles are tallied by pair, pairs below the number that similar sets
must share are dropped, and the rest is verified on all shingles.

Pairs are not made within groups that hang together already: first every list is compared with
its smallest member, and only members of different components meet afterwards, so a group of any
number of near copies costs about its size.  Shingles and sets are 64-bit hashes, 48 bits in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, durable, keep_least, resident, row_keys, slices, stored, tidy, trim
from .components import components
from .simhash import _hashes, fingerprints_of_sets, links
from .substrings import _gaps, _ranged, _values

WIDTH = 5
#: Least Jaccard similarity, as a fraction.
ALIKE = (4, 5)
#: One text in so many is sampled; a shingle that so many of these have is common; so many common ones are told apart.
SAMPLE = 16
COMMON = 8
MOST = 200_000
#: Bits of a shingle in the index; postings of one packed row's task and of one range, about; sets that a task tells apart.
KEY_BITS = 48
FLUSH, RANGE_POSTINGS = 1 << 20, 250_000
SEEN = 1 << 20
#: Rows (16 bytes each) up to which the keys of candidates' texts are broadcast; beyond it the texts are shuffled.
BROADCAST_ROWS = 500_000
_NO_WORDS = np.empty(0, dtype=np.uint64)


def _shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([_NO_WORDS, *_hashes(text or b"", width)]))


def _prefix(h: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last: those of which a similar set must share one."""
    n, (p, q) = len(h), ALIKE
    if not n:
        return h
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, often[at], 0)
    return h[np.lexsort((h, rank))[: n - -(-p * n // q) + 1]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([_NO_WORDS, *arrays]).view(np.int64)))


def _common(docs: DataFrame, width: int, text: str, sample: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their counts in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([_lists([_shingles(t, width) for t in piece.column(0).to_pylist()])], ["h"])

    some = docs.filter(F.pmod(F.xxhash64(F.col(text)), F.lit(sample)) == 0).select(body(text))
    counts = some.mapInArrow(tidy(run), "h array<long>").select(F.explode("h").alias("h")).groupBy("h").count().filter(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST).toArrow()
    h, often = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], often[order]


def _alike(shared: Column) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles that share so many are similar enough."""
    p, q = ALIKE
    return (p + q) * shared >= p * (F.col("na") + F.col("nb"))


def _may_be_alike(tally: Column) -> Column:
    """Whether sets whose prefixes share so many can be similar at all.

    Of the two sets, take the one whose prefix ends first: what it shares with the other lies in
    both prefixes or in its own rest, and the rest of n is ceil(0.8 n) - 1.
    """
    p, q = ALIKE
    rest = F.ceil(F.greatest("na", "nb") * p / q) - 1
    return _alike(tally + rest) & (q * F.col("na") >= p * F.col("nb")) & (q * F.col("nb") >= p * F.col("na"))


def _pack(bits: int):
    """Sets' prefixes as one row for each flush and range of keys: keys as gaps, owners as places in a list of sets."""
    names = ["bin", "keys", "owners", "sets", "sizes"]

    def rows(some: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([p for _, _, p in some]) >> np.uint64(64 - KEY_BITS)
        owner = np.repeat(np.arange(len(some)), [len(p) for _, _, p in some])
        sets, sizes = np.array([x for x, _, _ in some], dtype=np.int64), np.array([n for _, n, _ in some], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        out: list[list] = [[], [], [], [], []]
        for k, a, b in _ranged(keys >> np.uint64(KEY_BITS - bits)):
            mine, at = np.unique(owner[a:b], return_inverse=True)
            for column, x in zip(out, (k, _gaps(keys[a:b]), at.astype(np.uint32).tobytes(), sets[mine].tobytes(), sizes[mine].tobytes()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for one, n, prefix in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                some.append((one, n, np.frombuffer(prefix, dtype=np.uint64)))
                held += len(some[-1][2])
                if held >= FLUSH:
                    yield from rows(some)
                    some, held = [], 0
        if held:
            yield from rows(some)

    return run, "bin long, keys binary, owners binary, sets binary, sizes binary"


def _shared(group: pa.Table) -> pa.Table:
    """``key, set, n, pivot, pn`` of the keys of a range that two different sets have; pivot is the smallest of them."""
    resident()
    keys, sets, sizes = [], [], []
    for k, o, s, n in zip(*(group.column(c).to_pylist() for c in ("keys", "owners", "sets", "sizes")), strict=True):
        owner = np.frombuffer(o, dtype=np.uint32)
        keys.append(_values(k))
        sets.append(np.frombuffer(s, dtype=np.int64)[owner])
        sizes.append(np.frombuffer(n, dtype=np.int64)[owner])
    key, one, n = map(np.concatenate, (keys, sets, sizes))
    order = np.lexsort((one, key))
    key, one, n = key[order], one[order], n[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1])))
    key, one, n = key[new], one[new], n[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    trim()
    lead, many = np.repeat(first, count), np.repeat(count, count) > 1
    return pa.table({"key": key[many].astype(np.int64), "set": one[many], "n": n[many], "pivot": one[lead[many]], "pn": n[lead[many]]})


def _fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """``a, b, na, nb`` (a < b): sets of ``set, n, fp`` whose fingerprints are linked, if their sizes allow.

    Sets of one fingerprint meet its smallest, and of two linked fingerprints the smallest sets meet.
    """
    prints = durable(prints.distinct())
    least = durable(prints.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("r")).select("fp", F.col("r.set").alias("rep"), F.col("r.n").alias("rn")))
    same = prints.join(least, "fp").filter("set <> rep").select("set", "n", "rep", "rn")
    x, y = (least.select(F.col("fp").alias(e), F.col("rep").alias(f"s{e}"), F.col("rn").alias(f"n{e}")) for e in "ab")
    near = links(least.select("fp")).join(x, "a").join(y, "b").select("sa", "na", "sb", "nb")
    swapped, (p, q) = F.col("set") > F.col("rep"), ALIKE
    met = same.union(near).filter((q * F.col("n") >= p * F.col("rn")) & (q * F.col("rn") >= p * F.col("n")))
    return met.select(F.least("set", "rep").alias("a"), F.greatest("set", "rep").alias("b"), F.when(swapped, F.col("rn")).otherwise(F.col("n")).alias("na"), F.when(swapped, F.col("n")).otherwise(F.col("rn")).alias("nb"))


def _unlinked_pairs(shared: DataFrame, root: DataFrame) -> DataFrame:
    """``a, b, na, nb`` (a < b): sets of different components (``node, root``) that may be similar.

    Under a key all members but those of its most frequent component meet all members; that is
    every pair of different components, and each is tallied under all keys that it shares.
    """
    placed = shared.join(root, shared["set"] == root["node"], "left").select("key", "set", "n", F.coalesce("root", "set").alias("part"))
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "part")).alias("top")).filter("parts > 1").select("key", F.col("top.part").alias("top"))
    live = durable(placed.join(parts, "key"))
    a = live.filter("part <> top").select("key", F.col("set").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"))
    b = live.select("key", F.col("set").alias("y"), F.col("n").alias("ny"), F.col("part").alias("py"), "top")
    p, q = ALIKE
    met = a.join(b, "key").filter("px <> py and (py = top or x < y)").filter((q * F.col("nx") >= p * F.col("ny")) & (q * F.col("ny") >= p * F.col("nx")))
    swapped = F.col("x") > F.col("y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swapped, F.col("ny")).otherwise(F.col("nx")).alias("na"), F.when(swapped, F.col("nx")).otherwise(F.col("ny")).alias("nb"))
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("tally")).filter(_may_be_alike(F.col("tally"))).drop("tally")


def alike_groups(docs: DataFrame, width: int = WIDTH, text: str = "text", sample: int = SAMPLE, least: int = COMMON) -> DataFrame:
    """``doc_id, _k1, _k2, group`` for each row of ``docs``: rows of one group are linked by similar texts.

    _k1 and _k2 are hashes of the whole row.  Wordless and null texts are copies of each other; a
    text of fewer words than a shingle is one shingle.  The only things taken to the driver are
    the sample's common shingles, 200,000 at most; they steer the order, not the result.
    """
    common, often = _common(docs, width, text, sample, least)
    names = ["doc_id", "_k1", "_k2"]

    def measured(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for piece in slices(batch, 3):
                    sets = [_shingles(t, width) for t in piece.column(3).to_pylist()]
                    ids = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 5) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
                    kept: list[bytes | None] = []
                    for s, one in zip(sets, ids.tolist(), strict=True):
                        kept.append(None if one in seen else s.tobytes() if whole else _prefix(s, common, often).tobytes())
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(one)
                    new = [s if k is not None and not whole else _NO_WORDS for s, k in zip(sets, kept, strict=True)]
                    yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(ids), pa.array(list(map(len, sets)), pa.int64()), pa.array(fingerprints_of_sets(new)), pa.array(kept, pa.binary())], [*names, "set", "n", "fp", "h"])

        return run

    kind = "doc_id long, _k1 long, _k2 long, set long, n long, fp long, h binary"
    keyed = docs.select(F.col("doc_id").cast("long"), *row_keys(docs), body(text).alias("_text"))
    rows = stored(keyed.mapInArrow(tidy(measured(False)), kind))
    filed = rows.filter("h is not null").select("set", "n", "fp", "h")
    postings = int(filed.agg(F.coalesce(F.sum(F.length("h")), F.lit(0)).alias("b")).first()["b"]) // 8
    bits = max(1, (postings // RANGE_POSTINGS).bit_length())
    send, packed = _pack(bits)
    shared = stored(filed.drop("fp").mapInArrow(tidy(send), packed).groupBy("bin").applyInArrow(_shared, "key long, set long, n long, pivot long, pn long"))

    def verified(pairs: DataFrame) -> DataFrame:
        """``a, b`` of the pairs that are similar; the sets come once more from the texts."""
        pairs = durable(pairs)
        ends = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
        one = durable(rows.join(ends, "set", "left_semi").groupBy("set").agg(F.min(F.struct("_k1", "_k2")).alias("k")).select("k._k1", "k._k2"))
        one = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
        sets = stored(keyed.join(one, ["_k1", "_k2"], "left_semi").select(*names, "_text").mapInArrow(tidy(measured(True)), kind).filter("h is not null").select("set", "h").mapInArrow(_as_arrays, "set long, h array<long>").dropDuplicates(["set"]))
        x, y = sets.select(F.col("set").alias("a"), F.col("h").alias("ha")), sets.select(F.col("set").alias("b"), F.col("h").alias("hb"))
        return durable(pairs.join(x, "a").join(y, "b").filter(_alike(F.size(F.array_intersect("ha", "hb")))).select("a", "b"))

    stars = shared.filter("set <> pivot").groupBy(F.col("pivot").alias("a"), F.col("set").alias("b"), F.col("pn").alias("na"), F.col("n").alias("nb")).agg(F.count("*").alias("tally")).filter(_may_be_alike(F.col("tally"))).drop("tally")
    first = verified(_fingerprint_pairs(filed.drop("h")).union(stars).distinct())
    rest = verified(_unlinked_pairs(shared, components(first, "a", "b")))
    root = components(first.union(rest), "a", "b")
    return rows.join(root, rows["set"] == root["node"], "left").select(*names, F.coalesce("root", "set").alias("group"))


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([np.frombuffer(h, dtype=np.uint64) for h in batch.column(1).to_pylist()])], ["set", "h"])


def keep_unlike(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of ``docs``, all columns: the one with the smallest doc_id, nulls last.

    Ties go by the hashes of the whole row; of rows that are repeated whole one stays.  Rows with
    a null doc_id stay where no other row is like them.
    """
    return keep_least(docs, alike_groups(docs, **how))
