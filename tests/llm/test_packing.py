import zlib
from collections import Counter, defaultdict

import numpy as np

from geowarden.llm.bpe import bpe, vocabulary
from geowarden.llm.packing import pack
from tests.conftest import SF

PATH = vocabulary("word_bpe_49k.json")


def check(docs, length, **how):
    library, texts = bpe(PATH).library, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    rows = pack(docs, PATH, length=length, **how).collect()
    by, seen = defaultdict(list), Counter()
    for r in rows:
        by[r.sequence_id].append(r)
        assert r.length > 0
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert seen == Counter((d, k) for d, xs in ids.items() for x in xs for k in range(len(x)))
    padding = 0
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, 4096)
    check(docs.repartition(5), 256, open_windows=3)


def test_defined_cases(spark):
    schema = "doc_id long, text string, start string, ids int"
    rows = [(1, None, "x", 1), (2, "", None, None), (2, "a b", "x", 1), (2, "a b", "x", 1), (None, "c", "", 0)]
    check(spark.createDataFrame(rows, schema), 8)
    check(spark.createDataFrame(rows, schema), 1)
    assert pack(spark.createDataFrame([], schema), PATH).count() == 0
