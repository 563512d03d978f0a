import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geowarden.llm.bpe import vocabulary
from geowarden.llm.tokens import Counter, _library, counter, token_counts
from tests.conftest import SF

JSON = vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "\n a\n\nb c \t d", "x<|endoftext|>y <|endoftext|> z", "it's 'tis can 't", "a  b  c", "日本 語 \x1c x \x85 y", "1 2  3", " lead", "trail ", "a " * 3000]


def test_like_the_library():
    assert counter(JSON).count(ODD) == _library(JSON)(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab'.1 \n\t \x1c", max_size=40)), max_size=5))
def test_like_the_library_on_any_text(texts):
    assert counter(JSON).count(texts) == _library(JSON)(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies(name):
    assert Counter(vocabulary(name)).count(ODD) == _library(vocabulary(name))(ODD)


def test_on_the_table_and_defined_cases(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = dict(zip(texts, _library(JSON)(list(texts.values())), strict=True))
    assert {tuple(r) for r in token_counts(docs, JSON).collect()} == {(d, len(t.encode()), n[d], n[d] > 512) for d, t in texts.items()}
    schema = "doc_id long, text string, n_tokens string"
    rows = spark.createDataFrame([(1, None, "x"), (1, "", None), (None, "a b", "")], schema)
    assert [tuple(r) for r in token_counts(rows, JSON, limit=1).collect()] == [(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, True)]
    assert token_counts(spark.createDataFrame([], schema), JSON).count() == 0
