"""Secrets in texts: keyword prefilter, anchored expressions near hits, checksums.

One Aho-Corasick run over the lower-cased bytes finds every place where a keyword stands; the full
expressions are matched at those places only, from left to right, without overlaps within a kind.
Long hexadecimal runs have no keyword: a byte table and a substring search find them.  Tokens that
carry a checksum (six base-62 digits of CRC-32, or six Bech32 characters) count only if it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, slices, tidy

KINDS = ("assign", "access", "hex")
#: Kinds of the method's own: prefix and length of what follows, its last six characters a checksum.
CHECKED = {b"ghp_": 36, b"gho_": 36, b"ghu_": 36, b"ghs_": 36, b"ghr_": 36, b"npm_": 36}
#: The same for secret keys in Bech32: prefix, its human-readable part, and kind; all of one case.
BECH32 = {b"age-secret-key-1": "age", b"nsec1": "nostr"}
_BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_RUN = {True: re.compile(rb"[02-9ac-hj-np-z]+"), False: re.compile(rb"[02-9AC-HJ-NP-Z]+")}
_ORDER = {k: i for i, k in enumerate((*KINDS, "github", "npm", "age", "nostr"))}
_ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(rb"[0-9A-Za-z]+")
_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN = b"\x01" * 32


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, kind in (((b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), "assign"), ((b"akia",), "access"), (tuple(CHECKED), "checked"), (tuple(BECH32), "bech32")):
        for w in words:
            found.add_word(w.decode(), (kind, len(w)))
    found.make_automaton()
    return found


_KEYWORDS = _automaton()


def checksum(token: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of a token's random part."""
    n, out = zlib.crc32(token), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d : d + 1] + out
    return out


def bech32(prefix: bytes, data: list[int]) -> int:
    """The checksum polynomial of Bech32 over a prefix and five-bit values; 1 if the last six are right."""
    chk = 1
    for v in (*(c >> 5 for c in prefix), 0, *(c & 31 for c in prefix), *data):
        top = chk >> 25
        chk = (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            chk ^= g if top >> i & 1 else 0
    return chk


def find(text: bytes) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of every secret, in bytes, by start and then kind."""
    out: list[tuple[int, str, int]] = []
    done = dict.fromkeys(("assign", "access", "checked", "bech32"), 0)
    for last, (kind, size) in _KEYWORDS.iter(text.lower().decode("latin-1")):
        at = last + 1 - size
        if at < done[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, at):
                done[kind] = m.end()
                if m.end(1) - m.start(1) >= 8:
                    out.append((at, kind, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, at):
                done[kind] = m.end()
                if m.end() - at >= 16:
                    out.append((at, kind, m.end()))
        elif kind == "bech32":
            head = text[at : at + size]
            if head in (head.lower(), head.upper()) and (m := _BECH32_RUN[head.islower()].match(text, last + 1)) and m.end() - m.start() == 58 and not text[m.end() : m.end() + 1].isalnum():
                done[kind] = m.end()
                if bech32(head.lower()[:-1], [_BECH32.index(c) for c in m[0].lower()]) == 1:
                    out.append((at, BECH32[head.lower()], m.end()))
        elif (n := CHECKED.get(text[at : at + size])) and (m := _WORD.match(text, at + size)) and m.end() - m.start() == n:
            done[kind] = m.end()
            if checksum(m[0][:-6]) == m[0][-6:]:
                out.append((at, "npm" if text[at : at + 1] == b"n" else "github", m.end()))
    marks = text.translate(_HEX)
    at = marks.find(_RUN)
    while at >= 0:
        end = marks.find(b"\x00", at)
        end = len(text) if end < 0 else end
        out.append((at, "hex", end))
        at = marks.find(_RUN, end)
    return sorted(out, key=lambda x: (x[0], _ORDER[x[1]]))


def spans(text: bytes) -> list[tuple[int, str, int]]:
    """find() in code points."""
    found = find(text)
    if not found or text.isascii():
        return found
    places, at, seen = {}, 0, 0
    for p in sorted({x for s, _, e in found for x in (s, e)}):
        seen += len(text[at:p].decode(errors="replace"))
        places[p], at = seen, p
    return [(places[s], k, places[e]) for s, k, e in found]


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``.

    Null and empty texts have no spans (the digest of no bytes, an empty list); rows that repeat
    and null doc_ids give rows alike; an empty table gives none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                every = [spans(t) if t else [] for t in piece.column(1).to_pylist()]
                base = [[x for x in found if x[1] in KINDS] for found in every]
                counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([piece.column(0), *counts, pa.array([sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array(map(_joined, every), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), body(text)).mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: bytes) -> bytes:
    """The text with every secret replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in find(text):
        if start >= at:
            out += [text[at:start], b"[", kind.encode(), b"]"]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, all other columns as they are; null texts stay null."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, at):
                clean = pa.array([None if t is None else redact(t).decode(errors="replace") for t in piece.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(piece.columns)], piece.schema.names)

    schema = docs.schema
    return docs.withColumn(text, body(text)).mapInArrow(tidy(run), schema)
