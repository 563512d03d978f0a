import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from geowarden.llm.bpe import bpe, vocabulary
from tests.conftest import SF
from tests.llm import test_near, test_quality, test_secrets


def outside(texts, window):
    """Words of each text that lie in no window that occurs again."""
    words = {d: t.encode().split() for d, t in texts.items()}
    seen = Counter(tuple(ws[i : i + window]) for ws in words.values() for i in range(len(ws) - window + 1))
    out = {}
    for d, ws in words.items():
        gone = {i + k for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for k in range(window)}
        out[d] = [w for i, w in enumerate(ws) if i not in gone]
    return out


def redacted(text):
    out, at = [], 0
    for start, kind, end in test_secrets.brute(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_stages_against_brute_force(spark, tmp_path):
    # One source a language: with its own twenty sources this small table has no group that is large enough for an estimate.
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("s"))
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == columns
        before, kept = kept, {r.doc_id: r.text for r in docs.collect()}
        assert len(kept) == docs.count()
        if name == "quality":
            base = {d for d, t in before.items() if (n := test_quality.brute(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
            assert {d for d in base if labels.get(d) == 1} <= set(kept) <= base
            assert not any(labels.get(d) == 0 for d in kept) and all(kept[d] == before[d] for d in kept)
        if name == "near_duplicates":
            assert kept == {d: before[d] for d in set(test_near.brute(list(before.items())).values())}
        if name == "repeated_passages":
            assert {d: t.encode().split() for d, t in kept.items()} == outside(before, 35)
        if name == "secrets":
            assert kept == {d: redacted(t) for d, t in before.items()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    library = bpe(vocabulary("word_bpe_49k.json")).library
    pieces = defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(kept)
    for d, rows in pieces.items():
        ids, at = library.encode(kept[d], add_special_tokens=False).ids + [2], 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids) == rows[0].doc_tokens


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.filter("length < 1 or start < 0").count() == 0 and rows.count() > 0


def test_secrets_are_taken_out():
    text = 'x token = "' + "0a" * 20 + '" y'
    assert redacted(text) == 'x [assign]" y' and re.search("0a0a", redacted(text)) is None
