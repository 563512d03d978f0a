"""Token counts of whole texts, exactly as a tokenizer library gives them.

Texts are split at safe boundaries: single spaces between two characters that aren't white space,
which no token of these vocabularies spans.  Each distinct piece is encoded once a worker, in
batches of bounded bytes, and only its number of tokens is kept and returned.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, resident, slices

BATCH_BYTES = 256 << 10
#: Distinct pieces that a worker remembers before it starts afresh, and the longest of them.
STORE = 400_000
LONGEST = 64
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _library(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: list(map(len, piece.encode(texts, num_threads=1)))
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(own.encode_ordinary(t)) for t in texts]


def _splits(path: str) -> bool:
    """Whether a single space between two words begins a new token for certain: byte-level vocabularies."""
    if not path.endswith(".json"):
        return path.endswith(".tiktoken")
    import json

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    before = whole["pre_tokenizer"] or {}
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not any(c.isspace() for c in x["content"]) for x in whole["added_tokens"])
    return plain and not whole["normalizer"] and not whole["post_processor"] and before.get("type") == "ByteLevel" and before.get("use_regex", False) and not before.get("add_prefix_space", True)


class Counter:
    """Numbers of tokens of texts, with a bounded store of pieces."""

    def __init__(self, path: str) -> None:
        self.library, self.split = _library(path), _splits(path)
        self.known: dict[str, int] = {}

    def _measure(self, pieces: list[str]) -> list[int]:
        """Encodes in batches balanced by bytes."""
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for p in pieces:
            if batch and size + 4 * len(p) > BATCH_BYTES:
                out += self.library(batch)
                batch, size = [], 0
            batch.append(p)
            size += 4 * len(p)
        return out + (self.library(batch) if batch else [])

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Pieces of a text: all but the first begin with the space they were cut at."""
        parts = text.split(" ")
        if "" not in parts and not any(map(str.isspace, {c for p in parts for c in (p[0], p[-1])})):
            return [parts[0], *[" " + p for p in parts[1:]]]
        at = [0, *[m.start() for m in _SPACE.finditer(text)], len(text)]
        return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self._measure(texts)
        cut = [self._cut(t) if t else [] for t in texts]
        new = {p for ps in cut for p in ps}.difference(self.known)
        if len(self.known) + len(new) > STORE:
            self.known.clear()
            new = {p for ps in cut for p in ps}
        order = list(new)
        self.known.update(zip(order, self._measure(order), strict=True))
        out = [sum(map(self.known.__getitem__, ps)) for ps in cut]
        for p in order:
            if len(p) > LONGEST:
                del self.known[p]
        return out


def counter(path: str) -> Counter:
    return resident(f"counter {path}", lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) for each row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens; no begin, end or added tokens are counted, and
    names of special tokens inside a text count as the library takes them by default.  Repeated
    rows and null doc_ids give rows alike; an empty table gives none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            for piece in slices(batch, 1):
                texts = [(t or b"").decode(errors="replace") for t in piece.column(1).to_pylist()]
                n = model.count(texts)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long"), body(text), size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
