import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from geowarden.llm import near, simhash
from geowarden.llm.near import alike_groups


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """The smallest id of each id's group."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sets, 2):
        x, y = sets[i], sets[j]
        if x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in sets}


def named(rows):
    """The smallest id of each id's group, of alike_groups()."""
    least = {}
    for r in rows:
        least[r.group] = min(least.get(r.group, r.doc_id), r.doc_id)
    return {r.doc_id: least[r.group] for r in rows}


def test_stage_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values())) and got.columns == docs.columns


def test_edited_texts_around_the_limit(spark):
    rng = random.Random(3)
    notice = [f"n{k}" for k in range(30)]
    rows = [(0, None), (1, " "), (2, "One two"), (3, "one  TWO"), (4, "one two three")]
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 150))] + notice * (rng.random() < 0.7)
        for _ in range(3):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    want = brute(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for how in ({}, {"sample": 1, "least": 3}):
        assert named(alike_groups(df, **how).collect()) == want


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    schema = "doc_id long, text string, lang string, `a.b` map<string,string>"
    rows = [(1, a, "en", None), (1, a, "en", None), (None, b, None, None), (None, c, "en", None), (None, c, None, None), (5, c, "en", None), (2, d, "en", None), (2, e, "en", None), (3, e + " x", "en", None), (None, None, None, None), (None, "", None, None)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    kept = got.collect()
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=str) == sorted([(1, a), (None, b), (5, c), (2, d), (2, e), (None, "")], key=str)
    texts = {r.text for r in corpus_pipeline.repeated_passages(spark, got.withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert {a, b, c, d, e} <= texts
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_fingerprints_of_sets_are_majorities():
    rng = random.Random(6)
    sets = [np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64) for n in (0, 1, 2, 300, 0, 700)]
    want = [sum((2 * sum(int(h) >> k & 1 for h in s) > len(s)) << k for k in range(64)) for s in sets]
    assert simhash.fingerprints_of_sets(sets).view(np.uint64).tolist() == want


def test_stage_takes_links_of_fingerprints(spark, monkeypatch):
    rng = random.Random(7)
    prints = [rng.getrandbits(63) for _ in range(30)]
    prints += [p ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for p in prints[:20]] + prints[5:15]
    rows = [(k, rng.randrange(90, 110), p) for k, p in enumerate(prints)]
    sizes = {k: n for k, n, _ in rows}
    least = {p: min(k for k, _, x in rows if x == p) for p in prints}
    met = {(least[p], k) for k, _, p in rows if k != least[p]} | {tuple(sorted((least[p], least[x]))) for p, x in combinations(least, 2) if (p ^ x).bit_count() <= 2}
    want = sorted((a, b, sizes[a], sizes[b]) for a, b in met if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]))
    assert len(want) > 25
    assert sorted(map(tuple, near._fingerprint_pairs(spark.createDataFrame(rows * 2, "set long, n long, fp long")).collect())) == want

    seen = []
    monkeypatch.setattr(near, "links", lambda distinct: seen.append(distinct.count()) or simhash.links(distinct))
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(f"v{k}" for k in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2] and seen and seen[0] in (2, 3)
