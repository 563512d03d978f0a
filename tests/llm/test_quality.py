import random
from collections import Counter
from itertools import combinations

import numpy as np

from geowarden.llm.quality import LEAST, SCALE, Atoms, consistency, judge, keep_good, mcd, measure, quantile, statistics
from tests.conftest import SF


def brute(text):
    text = text or ""
    words = text.encode().split()
    chars = sum(len(w.decode()) for w in words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_match_brute_force():
    rng = random.Random(7)
    texts = [None, "", "  ", "a", "a b c a b c", "x\n\nx\n \nx\n", "é\x1c|é\x85 ##", "a b a b a b a"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", "|", "\x85", " "]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert measure(None if t is None else t.encode())[:5] == brute(t), t


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = judge(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        n, chars, symbols, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert len(rows) == len(texts) and all(r.kept for r in rows if r.doc_id in good and not r.base_failed)
    # Sources with fewer than LEAST rows of a language have no estimate.
    assert all(r.distance is None for r in rows if r.doc_id in bad and r.kept)


def test_junk_is_an_outlier_in_large_and_small_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = []
    for k in range(200):
        words = [word() for _ in range(80)]
        if k % 10 == 0:
            words = [w + "***" for w in words]
        rows.append((k, " ".join(words), "en", "hot" if k < 120 else f"s{k % 3}"))
    rows += [(1000, None, None, None), (1000, None, None, None), (None, "w " * 10, "en", None)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.kept} == {k for k in range(200) if k % 10}
    assert [r.distance for r in got if r.doc_id == 1000] == [None, None]
    assert judge(spark.createDataFrame([], "doc_id long, text string, distance int")).count() == 0


def exhaustive(x):
    """The smallest determinant of the covariance of any half, by trying all halves."""
    n, p = x.shape
    half = (n + p + 1) // 2
    ridge = 1e-4 * x.var(axis=0) + 1e-12
    return min(np.linalg.slogdet(np.cov(x[list(k)].T, bias=True) + np.diag(ridge))[1] for k in combinations(range(n), half))


def atoms(x):
    return Atoms(np.ones(len(x)), x, np.zeros((len(x), x.shape[1], x.shape[1])))


def test_smallest_determinant_of_all_halves():
    rng = np.random.default_rng(5)
    for n in (11, 12, 13, 14):
        x = rng.standard_normal((n, 4)) @ rng.standard_normal((4, 4))
        x[: n // 4] += 20
        assert abs(mcd(atoms(x))[2] - exhaustive(x)) < 1e-9


def test_a_cell_stands_for_its_rows():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 4))
    n = rng.integers(1, 5, 60)
    cov = np.cov(np.repeat(x, n, axis=0).T, bias=True)
    assert np.allclose(Atoms(n, x, np.zeros((60, 4, 4))).estimate(n.astype(float), np.zeros(4))[1], cov)


def test_scale_of_normal_data():
    """Consistent for normal data: the estimate is near the true covariance, and few rows lie beyond a quantile."""
    assert abs(quantile(0.025) - 11.143) < 1e-3 and abs(quantile(0.5) - 3.357) < 1e-3 and consistency(0.5) > 2
    rng = np.random.default_rng(7)
    root = rng.standard_normal((4, 4))
    x = rng.standard_normal((3000, 4)) @ root
    a = atoms(x)
    mean, cov, _ = mcd(a)
    assert np.allclose(cov, root.T @ root, atol=0.15 * np.abs(root.T @ root).max())
    assert 0.015 < (a.distance(mean, cov) > quantile(0.025)).mean() < 0.04


def docs_of(spark, vectors):
    """Texts of 400 words with so many capitals and marks each: the two rise together in usual ones."""
    rng = random.Random(10)
    rows = [(k, " ".join(("A" if i < c else "a") + ("." if i < m else "") + chr(97 + i % 26) * rng.randrange(9) for i in range(400)), "en", "s") for k, (c, m) in enumerate(vectors)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_correlation_counts(spark):
    """A text whose capitals and marks are usual one by one, but not together, is an outlier; a rule by medians and spreads keeps it."""
    rng = random.Random(9)
    usual = [(c, round(c * np.exp(0.07 * rng.gauss(0, 1)))) for c in (round(100 * np.exp(0.3 * rng.gauss(0, 1))) for _ in range(300))]
    docs = docs_of(spark, [*usual, (60, 170), (170, 60)])
    got = {r.doc_id: r.kept for r in judge(docs).collect()}
    assert not got[300] and not got[301] and all(got[k] for k in range(300))
    v = np.array([r.v for r in statistics(docs).orderBy("doc_id").collect()]) / SCALE
    spread = np.median(np.abs(v - np.median(v, axis=0)), axis=0) * 1.4826
    assert (np.square((v - np.median(v, axis=0)) / np.maximum(spread, 1e-3)).sum(axis=1)[300:] < quantile(1e-10)).all()


def test_small_groups_have_no_estimate(spark):
    docs = docs_of(spark, [(50, 50 + k % 3) for k in range(LEAST - 2)] + [(0, 400)])
    assert all(r.kept and r.distance is None for r in judge(docs).collect())
    rng = random.Random(11)
    docs = docs_of(spark, [(rng.randrange(40, 60), rng.randrange(40, 60)) for _ in range(LEAST)] + [(0, 400)])
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert not got[LEAST].kept and all(r.distance is not None for r in got.values())


def test_columns_of_any_name_and_bytes_that_are_no_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, 5, 6, {"a": 1})], "doc_id long, text string, row int, key int, `_row.x` map<string,int>")
    assert [tuple(r) for r in keep_good(docs).collect()] == [(1, text, 5, 6, {"a": 1})] and keep_good(docs).columns == docs.columns
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF6220C3' AS STRING) AS text")
    assert [(r.n_words, r.word_chars) for r in judge(odd).collect()] == [(2, 4)]


def test_a_third_of_identical_junk_is_rejected(spark):
    """A source may be junk for more than a quarter; labelled clean texts of it stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en'")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1").select("doc_id")
    good = [r for r in docs.join(labels, "doc_id", "left_semi").orderBy("doc_id").limit(400).collect() if (n := brute(r.text))[0] >= 50 and 100 * n[4] <= 50 * n[0]][:200]
    junk = " ".join(f"{w}|#{k}" for k, w in enumerate(good[0].text.split()[:80]))
    rows = [(r.doc_id, r.text, "en", "s") for r in good] + [(-1 - k, junk, "en", "s") for k in range(100)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(good) == 200 and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in good}
