import math
from collections import Counter

import numpy as np

from geowarden.llm import vectors
from geowarden.llm.vectors import COSINE, OPTIONS, planned_pairs, vector_groups

SF = "/root/testdata/sf0.1"


def brute(rows, t):
    good = {k: np.array(v, dtype=float) for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = Counter()
    for length in {len(x) for x in good.values()}:
        at = [k for k in good if len(good[k]) == length]
        x = np.array([good[k] / np.linalg.norm(good[k]) for k in at])
        for i, j in np.argwhere(np.triu(x @ x.T >= t, 1)).tolist():
            a, b = at[i], at[j]
            n[a] += 1
            n[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, n[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows))


def got(df, **how):
    return Counter(tuple(r) for r in vector_groups(df, **how).collect())


def test_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 0.9)
    assert got(df) == want


def test_near_groups_copies_and_defined_cases(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(20)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows) + 100, (centre + rng.standard_normal(20) * rng.choice([0.05, 0.25, 0.4])).tolist()))
    rows += [(5, rows[3][1]), (4, rows[3][1]), (3, [0.0] * 20), (2, None), (1, [1.0, None]), (0, [float("nan")] * 20), (-1, [float("inf"), 1.0]), (None, rows[3][1]), (-3, []), (-4, [-0.0, 1.0]), (-5, [0.0, 2.0]), (-6, [1e200] * 20), (-7, [1e-200] * 20), (-8, [3.0]), (-9, [4.0]), (-10, [-4.0])]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, [1.0, -5.0, 2.0])]
    df = spark.createDataFrame([(1, *r, "x") for r in rows], "kept int, vec_id long, embedding array<double>, links string")
    small = [(i, v) for i, v in rows if not v or v[0] is None or abs(v[0]) < 1e100 and abs(v[0]) > 1e-100 or v[0] == 0 or not math.isfinite(v[0])]
    want = brute(small, 0.9) + Counter({(-7, 1, -7, True): 1, (-6, 1, -7, False): 1})
    for how in ({}, {"chunk": 16, "tile": 5}, {"options": ((1, 2),)}, {"options": ((4, 2),), "chunk": 30}, {"options": ((7, 1), (30, 1))}):
        assert got(df, **how) == want, how
    assert vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def planned(spark, x):
    raw = spark.createDataFrame([(k, 0, 1, 0, v.astype(np.float64).tobytes(), x.shape[1]) for k, v in enumerate(x)], "rep long, cls long, size long, n long, raw binary, dim int")
    turn, schema = vectors._turning(vectors._fitted(raw.withColumn("cls", raw["rep"])))
    return planned_pairs(raw.mapInArrow(turn, schema), COSINE)


def test_never_more_than_all_pairs_and_few_on_clusters(spark):
    rng = np.random.default_rng(10)
    n = 1500
    even = rng.standard_normal((n, 64))
    assert min(planned(spark, even)) <= n * (n - 1) / 2
    centres = rng.standard_normal((30, 64)) * np.geomspace(2, 0.2, 64)
    clustered = centres[rng.integers(0, 30, n)] + 0.05 * rng.standard_normal((n, 64))
    few = planned(spark, clustered)
    assert min(few) < 0.65 * n * (n - 1) / 2
    assert min(x for x, (blocks, _) in zip(few, OPTIONS, strict=True) if blocks > 1) < n * (n - 1) / 2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered)], "vec_id long, embedding array<double>")
    assert got(df) == brute([(k, v.tolist()) for k, v in enumerate(clustered)], 0.9)
