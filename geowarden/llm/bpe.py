"""BPE with word ends: speculate with greedy longest matches, verify adjacent pairs, merge only what fails.

A word is proposed as the greedy longest-match cover of its bytes (one automaton run over all new
words).  A token sequence is what the merges would give exactly if every adjacent pair of it is,
so all pairs are tested together in numpy; words with a failing pair go through the merges
themselves, in rank order.  Words are remembered with their ids, so each distinct one is worked
out once a worker until the memory bound empties the store.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import body, resident, slices

#: Distinct words and ids that a worker remembers; beyond either it starts afresh.
STORE_WORDS = 300_000
STORE_IDS = 3_000_000
_END = "Ā"
_NONE = np.int64(1 << 40)
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Latin letters below U+0250 and what they are in lower case, with the classes of regex spelt out for re, which is faster.
_BEYOND = re.compile("[^\0-ɏ]")
_LOWER = "".join(sorted({x for k in range(0x250) for x in chr(k).lower()}))
_L, _N, _S = (re.escape("".join(regex.findall(c, _LOWER))) for c in (r"\p{L}", r"\p{N}", r"\s"))
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Places(dict):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Bpe:
    """Encodes and decodes as the tokenizers library does for a vocabulary of this kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        if model.get("end_of_word_suffix") != "</w>" or whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError(f"{path} is not a vocabulary of lower-cased words with word ends")
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in whole["added_tokens"]}
        self._cut = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        if size > 1 << 16:
            raise ValueError("ids beyond 65,535 are not handled")
        letters = byte_letters()
        self._byte = {c: b for b, c in enumerate(letters)}
        self.base = np.array([vocab[c] for c in letters])
        self.base_end = np.array([vocab[c + "</w>"] for c in letters])
        self.names = [b""] * size
        for name, k in vocab.items():
            self.names[k] = name.encode()
        for name, k in self.special.items():
            self.names[k] = name
        self.left, self.right = np.arange(size), np.arange(size)
        keys, made = [], []
        last = -1
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            k = vocab[a + b]
            if k <= last:
                raise ValueError("ids do not follow the order of the merges")
            last = k
            self.left[k], self.right[k] = vocab[a], vocab[b]
            keys.append(vocab[a] << 16 | vocab[b])
            made.append(k)
        if min(made) <= max(self.base.max(), self.base_end.max()):
            raise ValueError("merged tokens come before single bytes")
        order = np.argsort(keys)
        self._keys, self._made = np.array(keys)[order], np.array(made)[order]
        self._merge = dict(zip(keys, made, strict=True))
        self.length = np.zeros(size, dtype=np.int64)
        self._automaton = ahocorasick.Automaton()
        plain = []
        for name, k in vocab.items():
            end = name.endswith("</w>")
            text = "".join(chr(self._byte[c]) for c in (name[:-4] if end else name)) + _END * end
            self.length[k] = len(text)
            self._automaton.add_word(text, k)
            plain.append((text, k))
        self._automaton.make_automaton()
        self._checked, self._valid = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)
        # A proposal may only use tokens that the merges give for the token's own text.
        self._own = np.ones(size, dtype=bool)
        whole_words = [(t[:-1].encode("latin-1"), k) for t, k in plain if t[-1] == _END and len(t) > 1]
        for (_, k), ids in zip(whole_words, self._exact([w for w, _ in whole_words]), strict=True):
            self._own[k] = len(ids) == 1 and ids[0] == k
        inner = [(t.encode("latin-1"), k) for t, k in plain if t[-1] != _END]
        for (_, k), ids in zip(inner, self._exact([w for w, _ in inner], ends=False), strict=True):
            self._own[k] = len(ids) == 1 and ids[0] == k
        self.forget()

    # -- one word -----------------------------------------------------------------------------

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a pair merges into, _NONE where it doesn't."""
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._made[at], _NONE)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of neighbouring tokens as it is; answers are remembered by slot."""
        key = a << 16 | b
        slot = (key * 0x9E3779B1 >> 12) & ((1 << 20) - 1)
        out = self._valid[slot]
        new = np.flatnonzero(self._checked[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = self._undo(fresh >> 16, fresh & 0xFFFF)
            out[new] = found[back]
            slot = (fresh * 0x9E3779B1 >> 12) & ((1 << 20) - 1)
            self._checked[slot], self._valid[slot] = fresh, found
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        live, limit = np.arange(len(a)), np.full(len(a), _NONE)
        while len(live):
            alive = ~(self._lookup(a, b) < limit)
            a, b, limit, live = a[alive], b[alive], limit[alive], live[alive]
            first = a > b
            a1, b1 = self.right[a], self.left[b]
            a_base, b_base = a1 == a, b1 == b
            cut_a = np.where(first, ~a_base, b_base & ~a_base)
            cut_b = np.where(first, a_base & ~b_base, ~b_base)
            done = ~cut_a & ~cut_b
            out[live[done]] = True
            limit = np.where(cut_a, a, b + 1)
            a, b = np.where(cut_a, a1, a), np.where(cut_b, b1, b)
            a, b, limit, live = a[~done], b[~done], limit[~done], live[~done]
        return out

    def _exact(self, words: list[bytes], ends: bool = True) -> list[np.ndarray]:
        """The merges themselves, in rank order, for many words of one length together."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(words)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, all_at in by.items():
            if n > 48:
                for k in all_at:
                    out[k] = self._exact_long(words[k], ends)
                continue
            for lo in range(0, len(all_at), 20_000):
                at = all_at[lo : lo + 20_000]
                raw = np.frombuffer(b"".join(words[k] for k in at), dtype=np.uint8).reshape(-1, n)
                s = self.base[raw]
                if ends:
                    s[:, -1] = self.base_end[raw[:, -1]]
                self._merge_rows(s, np.array(at), out)
        return out

    def _merge_rows(self, s: np.ndarray, at: np.ndarray, out: list[np.ndarray]) -> None:
        made = self._lookup(s[:, :-1], s[:, 1:]) if s.shape[1] > 1 else np.empty((len(s), 0), dtype=np.int64)
        while True:
            if s.shape[1] == 1:
                done = np.ones(len(s), dtype=bool)
            else:
                p = made.argmin(axis=1)
                new = made[np.arange(len(s)), p]
                done = new >= _NONE
            for k, row in zip(at[done].tolist(), s[done], strict=True):
                out[k] = row
            if done.all():
                return
            s, at, made, p, new = s[~done], at[~done], made[~done], p[~done], new[~done]
            rows, width = np.arange(len(s)), s.shape[1] - 1
            s[rows, p] = new
            s = np.take_along_axis(s, np.arange(width) + (np.arange(width) > p[:, None]), axis=1)
            if width > 1:
                made = np.take_along_axis(made, np.arange(width - 1) + (np.arange(width - 1) >= p[:, None]), axis=1)
                r = np.flatnonzero(p > 0)
                made[r, p[r] - 1] = self._lookup(s[r, p[r] - 1], s[r, p[r]])
                r = np.flatnonzero(p < width - 1)
                made[r, p[r]] = self._lookup(s[r, p[r]], s[r, p[r] + 1])
            else:
                made = np.empty((len(s), 0), dtype=np.int64)

    def _exact_long(self, word: bytes, ends: bool) -> np.ndarray:
        """The same by a heap and a linked list, for words of any length."""
        ids = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        if ends:
            ids[-1] = int(self.base_end[word[-1]])
        n, merge = len(ids), self._merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := merge.get(ids[i] << 16 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            k, i, a, b = heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := merge.get(k << 16 | ids[after[i]])) is not None:
                    heappush(heap, (m, i, k, ids[after[i]]))
            if before[i] >= 0 and (m := merge.get(ids[before[i]] << 16 | k)) is not None:
                heappush(heap, (m, before[i], ids[before[i]], k))
        return np.array([x for x in ids if x >= 0])

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words one after the other, how many each has, and how many words needed the merges."""
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        joined = (b"\n".join(words) + b"\n").decode("latin-1").replace("\n", _END)
        found = np.fromiter(chain.from_iterable(self._automaton.iter_long(joined)), dtype=np.int64).reshape(-1, 2)
        ends, ids = found[:, 0], found[:, 1]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        owner = np.searchsorted(np.cumsum(sizes) - 1, ends)
        bad = np.bincount(owner, weights=self.length[ids], minlength=len(words)) != sizes
        bad[owner[~self._own[ids]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = ~self._compatible(ids[inner], ids[inner + 1])
        bad[owner[inner[wrong]]] = True
        count = np.bincount(owner, minlength=len(words))
        again = np.flatnonzero(bad)
        if len(again):
            exact = self._exact([words[k] for k in again.tolist()])
            keep = ~bad[owner]
            lens = np.fromiter(map(len, exact), dtype=np.int64, count=len(exact))
            count[again] = lens
            all_ids = np.concatenate([ids[keep], *exact])
            order = np.argsort(np.concatenate([owner[keep], np.repeat(again, lens)]), kind="stable")
            ids = all_ids[order]
        return ids, count, len(again)

    # -- whole texts --------------------------------------------------------------------------

    def _pieces(self, text: bytes) -> list[str]:
        """The words of a text, lower-cased and composed; special tokens stand as their own names."""
        if self._cut and b"<|" in text and len(parts := self._cut.split(text)) > 1:
            return [x for p in parts if p for x in ([" " + p.decode()] if p in self.special else self._pieces(p))]
        if text.isascii():
            return _ASCII.findall(text.lower().decode())
        letters = text.decode(errors="replace")
        if _BEYOND.search(letters) is None:
            return _LATIN.findall(unicodedata.normalize("NFC", letters).lower())
        letters = self.library.normalizer.normalize_str(letters)
        return [bytes(map(self._byte.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(letters)]

    def forget(self) -> None:
        self._known = _Places()
        self._starts, self._lens = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64)
        self._ids = np.empty(1 << 16, dtype=np.uint16)
        self._used = self._learnt = 0
        self._texts: list[bytes] = []
        if self.special:
            for name in self.special:
                self._known[" " + name.decode()]
            self._keep(np.array(list(self.special.values())), np.ones(len(self.special), dtype=np.int64))

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.empty(max(n, 2 * len(a)) - len(a), dtype=a.dtype)))

    def _keep(self, ids: np.ndarray, count: np.ndarray) -> None:
        """Takes in the ids of the words that came since."""
        k = self._learnt
        self._learnt += len(count)
        self._starts, self._lens = self._room(self._starts, self._learnt), self._room(self._lens, self._learnt)
        self._ids = self._room(self._ids, self._used + len(ids))
        self._ids[self._used : self._used + len(ids)] = ids
        self._starts[k : self._learnt] = self._used + np.cumsum(count) - count
        self._lens[k : self._learnt] = count
        self._used += len(ids)

    def _places(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The places of each text's words in the store; words go as soon as they are looked up."""
        out = []
        for t in texts:
            words = self._pieces(t) if t else []
            out.append(np.fromiter(map(self._known.__getitem__, words), dtype=np.int64, count=len(words)))
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Ids of all texts, the offsets of each, and each one's remembered words for decode_known()."""
        split = self._places(texts)
        if len(self._known) > self._learnt and (len(self._known) > STORE_WORDS or self._used > STORE_IDS):
            self.forget()
            split = self._places(texts)
        if len(self._known) > self._learnt:
            ids, count, _ = self.words([w.encode() for w in islice(self._known, self._learnt, None)])
            self._keep(ids, count)
        at = np.concatenate([np.empty(0, dtype=np.int64), *split])
        lens = self._lens[at]
        sums = np.concatenate(([0], np.cumsum(lens)))
        ids = self._ids[np.repeat(self._starts[at] - sums[:-1], lens) + np.arange(sums[-1])]
        words = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))))
        return ids.astype(np.uint32), sums[words], split

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """As decode(ids, skip_special_tokens=False) of a vocabulary without a decoder: names between spaces."""
        return b" ".join(map(self.names.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def decode_known(self, words: np.ndarray) -> bytes:
        """decode() of a text that encode() has just seen, by remembered words."""
        for k in range(len(self._texts), self._learnt):
            lo = self._starts[k]
            self._texts.append(self.decode(self._ids[lo : lo + self._lens[k]]))
        return b" ".join(map(self._texts.__getitem__, words.tolist()))


def bpe(path: str) -> Bpe:
    return resident(f"bpe {path}", lambda: Bpe(path))


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: the operator's real output.  Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for piece in slices(batch, 1):
                ids, offsets, _ = model.encode(piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), body(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from rows with an array of ids; null gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []).decode() for x in batch.column(1).to_pylist()])], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col(ids)).mapInArrow(run, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``, its text encoded and decoded.

    Null and empty texts have no tokens and the digests of no bytes; repeated rows and null
    doc_ids give rows alike; an empty table gives none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for piece in slices(batch, 1):
                ids, offsets, words = model.encode(piece.column(1).to_pylist())
                raw, at = ids.tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(np.diff(offsets)),
                        pa.array([sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                        pa.array([sha256(model.decode_known(w)).hexdigest() for w in words]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), body(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
