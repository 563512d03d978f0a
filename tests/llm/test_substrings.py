import random
import tracemalloc
from collections import Counter
from hashlib import sha256

from geowarden.llm.substrings import _Part, remove_repeats, repeat_digests
from tests.conftest import SF


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(repeat_digests(docs, part_bytes=60_000, range_values=5_000)) == brute([(r.doc_id, r.text) for r in docs.collect()], 35)


def test_small_windows_and_defined_cases(spark):
    rng = random.Random(3)
    schema = "part int, doc_id long, text string, bin string"
    rows = [(1, k, " ".join(rng.choice("abc") for _ in range(rng.randrange(40))), "x") for k in range(60)]
    rows += [(None, None, "a b c d e f g", None), (2, 7, None, "y"), (2, 7, "", "y"), (2, 8, "k l m n o p q r " * 3, "y"), (2, 8, "k l m n o p q r " * 3, "y")]
    docs = spark.createDataFrame(rows, schema)
    for window in (1, 2, 5, 8, 9):
        assert got(repeat_digests(docs, window=window, part_bytes=200, range_values=50)) == brute([(r[1], r[2]) for r in rows], window), window
    assert repeat_digests(spark.createDataFrame([], schema)).count() == remove_repeats(spark.createDataFrame([], schema)).count() == 0
    assert Counter(tuple(r)[:2] + tuple(r)[3:] for r in remove_repeats(docs).collect()) == Counter(r[:2] + r[3:] for r in rows)


def test_text_that_is_left(spark):
    passage = " ".join(f"w{k}" for k in range(35))
    rows = [(1, f"first  line\n{passage} end\n"), (2, f"{passage}\nother"), (3, f"clean\ttext  stays\n")]
    left = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1: "first  line\nend\n", 2: "other", 3: "clean\ttext  stays\n"}


def test_null_ids_and_a_common_header_spread(spark):
    from geowarden.llm.substrings import _placed

    rows = [(None, "the same header of every page " * 5 + str(k)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in _placed(docs, docs["doc_id"], "text", 64).groupBy("part").count().collect()]
    assert len(sizes) > 55 and max(sizes) < 30


def test_a_cluster_has_to_name_its_folder():
    import pytest

    from geowarden.llm.common import shared_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_a_part_keeps_hashes_not_words():
    texts = [b" ".join(b"w%07d" % k for k in range(a, a + 20_000)) for a in range(0, 200_000, 20_000)]
    tracemalloc.start()
    part = _Part(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert part.n.tolist() == [20_000] * 10 and held < 2_500_000
