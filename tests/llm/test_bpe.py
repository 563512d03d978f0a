import random
import tracemalloc
import unicodedata

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from geowarden.llm.bpe import _LATIN, bpe, bpe_digests, decoded, encoded, vocabulary
from tests.conftest import SF

PATH = vocabulary("word_bpe_49k.json")
ODD = ["", "  ", "Hello <|endoftext|>World<|startoftext|>", "don't 'tis I'LL we're", "ΑΣ ΟΔΟΣ İstanbul ǅ", "é ạ̈ x y z \x1c\x1d a\x85b", "日本語 テスト 한국어 ไทย", "😀😀 ½²³ª", " \n\t tab", "x" * 5000, "ab" * 3000 + "!?" * 500, "<|EndOfText|> <|endoftext|", "ſtraße ẞ ﬁ", "́start", "a ́b", "\x00 \x01\x7f", "wait.. ...no!!' s", "<|endoftext|>" * 3]


def check(texts):
    model = bpe(PATH)
    ids, at, words = model.encode([None if t is None else t.encode() for t in texts])
    for k, t in enumerate(texts):
        want = model.library.encode(t or "", add_special_tokens=False).ids
        mine = ids[at[k] : at[k + 1]].tolist()
        assert mine == want, t
        text = model.library.decode(want, skip_special_tokens=False).encode()
        assert model.decode_known(words[k]) == text == model.decode(mine)


def test_like_the_library_on_odd_texts():
    check([*ODD, None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="abEé's.,!1 \n<|>", max_size=30)), max_size=5))
def test_like_the_library_on_any_text(texts):
    check(texts)


def test_like_the_library_when_the_store_is_full(monkeypatch):
    monkeypatch.setattr("geowarden.llm.bpe.STORE_WORDS", 50)
    rng = random.Random(4)
    for _ in range(6):
        check([" ".join("".join(rng.choice("thersonigad") for _ in range(rng.randrange(1, 60))) for _ in range(30))])


def test_speculation_equals_merging():
    model, rng = bpe(PATH), random.Random(5)
    words = list({"".join(rng.choice("thersonigad") for _ in range(rng.randrange(1, 16))).encode() for _ in range(4000)})
    ids, count, merged = model.words(words)
    assert 0 < merged < len(words)
    assert ids.tolist() == np.concatenate(model._exact(words)).tolist() and count.tolist() == list(map(len, model._exact(words)))
    assert [x.tolist() for x in model._exact(words)] == [model._exact_long(w, True).tolist() for w in words]


def test_tables_and_defined_cases(spark):
    from hashlib import sha256

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = bpe(PATH).library
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(docs, PATH).collect()} == want
    schema = "doc_id long, text string, ids string, n_tokens int"
    none = sha256(b"").hexdigest()
    rows = spark.createDataFrame([(1, None, "", 1), (1, "", None, 2), (None, "hi hi", "", 3)], schema)
    assert [tuple(r)[:3] for r in bpe_digests(rows, PATH).collect()][:2] == [(1, 0, none)] * 2
    back = decoded(encoded(rows, PATH), PATH).collect()
    assert [tuple(r) for r in back] == [(1, ""), (1, ""), (None, "hi</w> hi</w>")]
    assert bpe_digests(spark.createDataFrame([], schema), PATH).count() == 0


def test_classes_of_latin_words():
    rng = random.Random(8)
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    for _ in range(3000):
        text = unicodedata.normalize("NFC", "".join(chr(rng.randrange(0x250)) for _ in range(40))).lower()
        assert _LATIN.findall(text) == pattern.findall(text)


def test_encode_lets_words_go():
    texts = [" ".join(f"wort{k % 50} né," for k in range(4000)).encode()] * 25
    model = bpe(PATH)
    ids, offsets, _ = model.encode(texts[:1])
    tracemalloc.start()
    many, ends, _ = model.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert many.tolist() == ids.tolist() * 25 and ends.tolist() == [k * len(ids) for k in range(26)]
    assert most < 52 * len(many)
