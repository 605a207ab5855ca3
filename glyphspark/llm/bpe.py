"""Op 4: BPE encoding and decoding.

Encoding keeps a doubly linked list of symbols and a priority queue of merges by rank and place; an entry whose
symbols have changed since it was queued is stale and skipped. Decoding concatenates vocabulary strings.
A slice of texts is cut into pre-tokens on its bytes; each distinct one is looked up or encoded once, in a table that each
worker keeps up to a bound, and the texts' ids are gathered from the entries by index. Memory doesn't follow the
corpus; no shuffle, no state between rows, so a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._pretokens import LONG_PIECE, cuts_words, distinct, pretokens

#: Pieces that one worker remembers at most; beyond, it starts afresh.
CACHE_PIECES = 150_000
#: Text bytes that are encoded at once.
SLICE_BYTES = 1 << 20
#: Bits of a queue entry that hold a place.
_PLACE = 40
_PLACES = (1 << _PLACE) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if visible, else the next free one from U+0100."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE with an end-of-word suffix, read from a tokenizer file: encodes and decodes as the tokenizers library does for it."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right, self.made = ([self.vocab[x] for x in xs] for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.ranks = {(a, b): rank << _PLACE for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.spaced = {i: " " + s for i, s in self.strings.items()}
        self.decimal = {i: f" {i}" for i in self.strings}
        letters = byte_letters()
        self.inner, self.last = ([self.vocab.get(x + end) for x in letters] for end in ("", self.suffix))
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cuts = cuts_words(spec)
        self.table: dict[int, tuple[int, str, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        body = word.encode("utf-8")
        ids = [self.inner[b] for b in body[:-1]] + [self.last[b] for b in body[-1:]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n, ranks = len(ids), self.ranks
        # an entry is a merge's rank and the place of its left symbol in one number, so the queue compares numbers
        queue = [ranks[pair] + k for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in ranks]
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, k = entry >> _PLACE, entry & _PLACES
            to = after[k]
            if to >= n or ids[k] != self.left[rank] or ids[to] != self.right[rank]:
                continue  # stale: one of its symbols has been merged already
            made = self.made[rank]
            ids[k], ids[to] = made, -1
            after[k] = far = after[to]
            if far < n:
                before[far] = k
                if (found := ranks.get((made, ids[far]))) is not None:
                    heappush(queue, found + k)
            if (near := before[k]) >= 0 and (found := ranks.get((ids[near], made))) is not None:
                heappush(queue, found + near)
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = after[k]
        return out

    @staticmethod
    def normal(text: str) -> str:
        """Composed and in lower case, letter by letter as the library does it (Python lowers a final sigma differently)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return "".join(c.lower() for c in text)
        return text.lower()

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Strings of special tokens become their ids, as the library does by default."""
        out: list[int] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.word.findall(self.normal(part)):
                out += self.encode_word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids for a file without a decoder: vocabulary strings, one space between."""
        return " ".join(self.strings[i] for i in ids)

    def entry(self, piece: str) -> tuple[int, str, str]:
        """Of a pre-token or a piece without white space: count of ids, ids as text and decoded text, each id after a space."""
        ids = self.encode_word(piece.lower()) if self.cuts and piece.isascii() and piece.isalpha() else self.encode(piece)
        return len(ids), "".join([self.decimal[i] for i in ids]), "".join([self.spaced[i] for i in ids])

    def entries(self, texts: pa.Array) -> tuple[list[tuple[int, str, str]], np.ndarray, np.ndarray]:
        """Entries of the distinct pre-tokens of some texts, for every pre-token the index of its entry, and n + 1 offsets of texts."""
        data, offsets = V.text_bytes(texts)
        value, start, end, at = pretokens(data, offsets, self.cuts)
        value, first, which = distinct(value)
        if len(self.table) >= CACHE_PIECES:
            self.table.clear()
        table, raw, found = self.table, data.tobytes(), []
        for key, a, b in zip(value.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            if (got := table.get(key)) is None:
                got = self.entry(raw[a:b].decode())
                if b - a < LONG_PIECE:
                    table[key] = got
            found.append(got)
        return found, which, at


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _joined(strings: list[str], which: np.ndarray, at: np.ndarray) -> list[memoryview]:
    """For every text its strings end to end, without the first space."""
    taken = pa.array(strings, pa.large_string()).take(pa.array(which))
    if not len(taken):
        return [memoryview(b"")] * (at.size - 1)
    _, ends, body = taken.buffers()
    ends, body = np.frombuffer(ends, np.int64, len(taken) + 1, taken.offset * 8)[at].tolist(), memoryview(body) if body is not None else memoryview(b"")
    return [body[a + 1 : b] if b > a else body[:0] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _per_text(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the pre-tokens' counts by text."""
    return np.diff(np.concatenate([[0], np.cumsum(counts)])[at])


def bpe(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text; other columns are ignored).

    Rows: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256, and if asked for
    ``ids`` (array of int) and ``decoded``. A null or empty text has no ids and an empty decoded text. Rows repeat as
    the input's do; a null doc_id stays null; an empty table gives an empty one. A text is encoded whole, however long.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def encoded(batch: pa.RecordBatch, coder: WordBpe) -> pa.RecordBatch:
        found, which, at = coder.entries(batch.column(1))
        counts = np.array([x[0] for x in found], np.int64)[which]
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        decoded = _joined([x[2] for x in found], which, at)
        out = [batch.column(0), pa.array(_per_text(counts, at), pa.int64()), sha(_joined([x[1] for x in found], which, at)), sha(decoded)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([x[0] for x in found], dtype=np.int64)])
            ids = np.fromstring("".join([x[1] for x in found]), np.int32, sep=" ")
            flat = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids)).take(pa.array(which)).flatten()
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])[at], pa.int32()), flat))
            names.append("ids")
        if with_text:
            out.append(pa.array([str(x, "utf-8") for x in decoded], pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        try:
            for batch in batches:
                for part in V.slices(batch, limit=SLICE_BYTES):  # what is made of a slice is passed on before the next
                    yield encoded(part, coder)
        finally:  # a worker lives on for other work
            del coder
            _loaded.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(V.releasing(run), schema)
