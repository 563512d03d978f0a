import random
from itertools import combinations

import xxhash

from geowarden.llm.simhash import fingerprints_of, keep_one, links, simhash_groups
from tests.conftest import SF


def brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    fp = {i: brute(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(fp, 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {(i, fp[i], find(i)) for i in fp}


def test_fingerprints_match_brute_force():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one two", "A b C", "É è a b\x1cc d e f", None, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(3000)), "x " * 70000]
    got = fingerprints_of([None if t is None else t.encode() for t in texts])
    assert [int(x) % 2**64 for x in got] == [brute(t) for t in texts]


def test_groups_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(docs).collect()}
    assert got == groups([(r.doc_id, r.text) for r in docs.collect()])


def test_links_in_short_and_long_lists(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)] + [0xABCD1234 << 32 | rng.getrandbits(32) for _ in range(60)]
    fps = set(base)
    for x in base:
        for n in (1, 2, 3):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    want = {tuple(sorted(p)) for p in combinations(signed, 2) if ((p[0] ^ p[1]) % 2**64).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for longest in (1000, 3):
        got = [tuple(r) for r in links(df, longest=longest).collect()]
        assert set(got) == want and len(got) == len(want)


def test_defined_cases(spark):
    schema = "doc_id long, text string, fp int, component_id string"
    rows = [(5, None, 1, "x"), (3, "", None, None), (3, "", None, None), (None, "a b c d", 2, "y"), (9, "a b c d", 2, "y"), (7, "q r s t u", 0, "z")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 9), (9, 9), (7, 7)], key=str)
    assert simhash_groups(spark.createDataFrame([], schema)).count() == 0
    kept = keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"] and sorted(r.doc_id for r in kept.collect()) == [3, 7, 9]
    rows = [(None, "a b c d", 1, "x"), (None, "q r s t u", 2, "x"), (1, "k l m n", 3, "x"), (1, "z y x w v", 4, "x")]
    assert keep_one(spark.createDataFrame(rows, schema)).count() == 4
