"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics: logarithms of characters, punctuation and
symbols, capitals and short words a word, shrunk towards usual rates by so many words that short
texts do not scatter more than long ones.  For every (language, source) the minimum covariance
determinant (MCD) is estimated over all distinct vectors of texts that pass the limits (copies of
a text would draw the estimate to it): concentration steps from several seeded starts, each until
the determinant falls no more, the smallest determinant, the factor that makes it consistent for
normal data, and one reweighting.  Rows with a large Mahalanobis distance are rejected.

Steps run on counts: vectors fall into cells of a fixed fine grid, and a cell keeps their number
and exact first and second moments (fixed-point integers, so the order of rows does not matter).
Cells of a group are bounded by the grid, whatever the number of rows, and one task takes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, durable, slices, tidy

FEATURES = 4
#: Fixed-point scale of a vector's components, and bits below a cell's border for each: cells are 1/256, 1/32, 1/16 and 1/64 wide.
SCALE = 1 << 20
SHIFT = (12, 15, 16, 14)
#: Words of usual text that are added to each text, and what these hold a word: characters, punctuation, capitals, short words.
PRIOR, USUAL = 200, (5.0, 0.15, 0.085, 0.35)
#: Bytes up to which a word is short.
SHORT = 3
#: Seeded starts of a group, and those that are followed to the end after two steps each.
STARTS, FOLLOWED = 24, 6
#: Distinct vectors below which a group has no estimate (five for each component); the limits alone decide there.
LEAST = 20
#: Share of a component's variance that is added to covariances: only there to keep them invertible.
RIDGE = 1e-4
#: Chance for a row of normal data to be rejected: about one in the largest corpora.
TAIL = 1e-10
#: Groups up to which estimates are joined by broadcast (about 0.3 kB each).
BROADCAST_GROUPS = 2_000
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CAPITALS = bytes(range(65, 91))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(words: list[bytes]) -> int:
    """Words in 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    n = len(known)
    pairs = ids[:-1] * n + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, where, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= again
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, and punctuation, capitals and short words of a whole text."""
    if not text:
        return (0,) * 8
    words = text.split()
    chars = sum(map(len, words)) if text.isascii() else sum(map(len, text.decode(errors="replace").translate(_SPACES).split(" ")))
    symbols = len(_SYMBOLS.findall(text))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    short = int((np.fromiter(map(len, words), dtype=np.int64, count=len(words)) <= SHORT).sum())
    marks, capitals = (len(text) - len(text.translate(None, x)) for x in (_PUNCTUATION, _CAPITALS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeats(words), marks, capitals, short


_SPACES = dict.fromkeys(range(9, 14), " ")


def _vector(n: int, chars: int, marks: int, capitals: int, short: int) -> list[int] | None:
    if not n:
        return None
    return [round(log((x + PRIOR * u) / (n + PRIOR)) * SCALE) for x, u in zip((chars, marks, capitals, short), USUAL, strict=True)]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, lang, source``, the five counts and the fixed-point vector ``v`` (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 3):
                rows = [measure(t) for t in piece.column(3).to_pylist()]
                counts = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *counts, pa.array([_vector(r[0], r[1], *r[5:]) for r in rows], pa.list_(pa.int64()))], ["doc_id", "lang", "source", *_COUNTS, "v"])

    named = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("long"), *named, body(text)).mapInArrow(tidy(run), f"doc_id long, lang string, source string, {', '.join(f'{c} long' for c in _COUNTS)}, v array<long>")


# -- the estimate of one group --------------------------------------------------------------------


def _chi(x: float, half: int) -> float:
    """Distribution function of chi-squared with 2 * half degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, half):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


@lru_cache(maxsize=None)
def quantile(tail: float, half: int = FEATURES // 2) -> float:
    """What chi-squared with 2 * half degrees of freedom exceeds with chance ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        term, total = 1.0, 1.0
        for k in range(1, half):
            term *= middle / 2 / k
            total += term
        low, high = (middle, high) if exp(-middle / 2) * total > tail else (low, middle)
    return high


def consistency(share: float) -> float:
    """Factor by which the covariance of the nearest ``share`` of normal rows has to grow."""
    return share / _chi(quantile(1 - share), FEATURES // 2 + 1) if share < 1 else 1.0


class Atoms:
    """Cells of a group: numbers of rows, means, and scatter within each."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> None:
        self.n, self.mean, self.scatter = n.astype(np.float64), mean, scatter
        every = self.estimate(self.n, np.zeros(mean.shape[1]))[1]
        self.ridge = RIDGE * np.diag(every) + 1e-12

    def estimate(self, weight: np.ndarray, ridge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the atoms with so many rows of each."""
        total = weight.sum()
        mean = weight @ self.mean / total
        apart = self.mean - mean
        share = weight / self.n
        cov = ((apart * weight[:, None]).T @ apart + np.tensordot(share, self.scatter, 1)) / total
        return mean, cov + np.diag(self.ridge if ridge is None else ridge)

    def distance(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        apart = self.mean - mean
        return np.einsum("ij,jk,ik->i", apart, np.linalg.inv(cov), apart)

    def nearest(self, distance: np.ndarray, rows: int) -> np.ndarray:
        """Weights of the ``rows`` nearest rows; of the last atom only as many as are wanted."""
        order = np.argsort(distance, kind="stable")
        upto = np.cumsum(self.n[order])
        weight = np.empty(len(order))
        weight[order] = np.clip(rows - (upto - self.n[order]), 0, self.n[order])
        return weight


def mcd(atoms: Atoms, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Reweighted MCD: mean, covariance, and the logarithm of the raw determinant."""
    rows = int(atoms.n.sum())
    p = atoms.mean.shape[1]
    half = (rows + p + 1) // 2
    rng = np.random.default_rng(seed)

    def steps(weight: np.ndarray, most: int) -> tuple[float, np.ndarray]:
        """Concentration from a subset until the determinant falls no more."""
        det = np.inf
        for k in range(most):
            mean, cov = atoms.estimate(weight)
            now = np.linalg.slogdet(cov)[1]
            if k > 1 and now >= det - 1e-12:  # the start itself is smaller than half of the rows
                break
            det, best = now, weight
            weight = atoms.nearest(atoms.distance(mean, cov), half)
        return det, best

    def start(k: int) -> np.ndarray:
        weight = np.zeros(len(atoms.n))
        if k:
            weight[rng.choice(len(weight), min(p + 1, len(weight)), replace=False)] = 1.0
            return weight
        order = [np.argsort(x, kind="stable") for x in atoms.mean.T]
        middle = np.array([x[o][np.searchsorted(np.cumsum(atoms.n[o]), rows / 2)] for x, o in zip(atoms.mean.T, order, strict=True)])
        return atoms.nearest((np.square(atoms.mean - middle) / (atoms.ridge / RIDGE)).sum(axis=1), half)

    tried = sorted((steps(start(k), 3) for k in range(STARTS)), key=lambda x: x[0])[:FOLLOWED]
    det, weight = min((steps(w, 200) for _, w in tried), key=lambda x: x[0])
    mean, cov = atoms.estimate(weight)
    near = atoms.distance(mean, cov * consistency(half / rows)) <= quantile(0.025)
    mean, cov = atoms.estimate(np.where(near, atoms.n, 0.0)) if near.any() else (mean, cov)
    return mean, cov * consistency(0.975), det


_PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]


def _estimate(cells: pa.Table) -> pa.Table:
    """Mean and inverse covariance of one group from its cells; none for a group of few rows."""
    column = lambda c: cells.column(c).to_numpy().astype(np.float64)
    n = column("n")
    names = {c: cells.column(c).slice(0, 1) for c in ("lang", "source")}
    if n.sum() < LEAST:
        return pa.table(names | {"mean": pa.array([None], pa.list_(pa.float64())), "inverse": pa.array([None], pa.list_(pa.float64()))})
    order = np.lexsort([column(f"c{k}") for k in range(FEATURES)])
    first = np.stack([column(f"s{k}") for k in range(FEATURES)], axis=1)
    corner = np.stack([(column(f"c{k}") + 0.5) * (1 << SHIFT[k]) for k in range(FEATURES)], axis=1)
    scatter = np.empty((len(n), FEATURES, FEATURES))
    for i, j in _PAIRS:
        scatter[:, i, j] = scatter[:, j, i] = column(f"s{i}{j}") - first[:, i] * first[:, j] / n
    mean, cov, _ = mcd(Atoms(n[order], ((corner + first / n[:, None]) / SCALE)[order], (scatter / SCALE**2)[order]))
    return pa.table(names | {"mean": pa.array([mean.tolist()]), "inverse": pa.array([np.linalg.inv(cov).ravel().tolist()])})


# -- all groups -----------------------------------------------------------------------------------


def _cells(rows: DataFrame) -> DataFrame:
    """Cells of every group: distinct vectors, and sums and products of what lies between them and the cell's middle."""
    v = [F.col("v")[k] for k in range(FEATURES)]
    cell = [F.shiftright(x, SHIFT[k]) for k, x in enumerate(v)]
    off = [x - F.shiftleft(c, SHIFT[k]) - (1 << SHIFT[k] - 1) for k, (x, c) in enumerate(zip(v, cell, strict=True))]
    some = rows.select("lang", "source", "v").distinct().select("lang", "source", *[c.alias(f"c{k}") for k, c in enumerate(cell)], *[x.alias(f"r{k}") for k, x in enumerate(off)])
    sums = [F.sum(f"r{k}").alias(f"s{k}") for k in range(FEATURES)] + [F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]
    return some.groupBy("lang", "source", *[f"c{k}" for k in range(FEATURES)]).agg(F.count("*").alias("n"), *sums)


def _distance() -> Column:
    d = [F.col("v")[k] / F.lit(float(SCALE)) - F.col("mean")[k] for k in range(FEATURES)]
    total = F.lit(0.0)
    for i in range(FEATURES):
        for j in range(FEATURES):
            total = total + d[i] * d[j] * F.col("inverse")[i * FEATURES + j]
    return F.greatest(total, F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def outliers(stats: DataFrame, tail: float = TAIL) -> DataFrame:
    """``stats`` (without lang and source) with ``distance`` (squared; null without words or estimate) and ``outlier``.

    Estimates rest on the distinct vectors of rows that pass the limits.  Null languages and
    sources are groups of their own.  In groups of fewer than LEAST such vectors nothing is an outlier.
    """
    keyed = stats.withColumn("lang", F.coalesce("lang", F.lit("\x00"))).withColumn("source", F.coalesce("source", F.lit("\x00")))
    cells = _cells(keyed.filter(F.col("v").isNotNull() & ~base_failed()))
    found = durable(cells.groupBy("lang", "source").applyInArrow(_estimate, "lang string, source string, mean array<double>, inverse array<double>"))
    small = found.count() <= BROADCAST_GROUPS
    judged = keyed.join(F.broadcast(found) if small else found, ["lang", "source"], "left")
    distance = F.when(F.col("v").isNotNull() & F.col("mean").isNotNull(), _distance())
    return judged.select(*[c for c in stats.columns if c not in ("lang", "source")], distance.alias("distance"), F.coalesce(distance > quantile(tail), F.lit(False)).alias("outlier"))


def judge(docs: DataFrame, text: str = "text", tail: float = TAIL) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``distance`` for each row of ``docs``.

    A null text has no words and fails.  Rows that repeat and null doc_ids are judged alike; an
    empty table gives no rows; columns ``lang`` and ``source`` may be missing or null.  Bytes that
    are no UTF-8 count as U+FFFD.
    """
    found = outliers(durable(statistics(docs, text)), tail)
    return found.select("doc_id", *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.col("outlier")).alias("kept"), "distance")


def keep_good(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, all columns, whatever their names; rows alike in text, language and source share a verdict."""
    given = [F.col(c).cast("string") for c in ("lang", "source") if c in docs.columns]
    key = F.xxhash64(F.lit(11), F.col(text), *given, *[c.isNull() for c in given])
    good = judge(docs.select(key.alias("doc_id"), *[F.col(c) for c in ("lang", "source") if c in docs.columns], F.col(text).alias("text")), **how).filter("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(good, keyed["key"] == good["kept_key"], "left_semi").select("row.*")
