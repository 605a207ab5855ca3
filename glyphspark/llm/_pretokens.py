"""Pre-tokens of a word vocabulary, cut from byte buffers: letters, single digits, runs of other marks, between white space.

The cut is that of one pattern (``WORD_PATTERN``) after composing and lowering, done on byte classes where those decide
it: ASCII but for apostrophes (the pattern's contractions), ``<`` (special strings begin with it) and control characters,
and the precomposed letters from U+00C0 to U+017F but U+0130, which lowers to a letter and a mark. A piece between white space with anything else in it stays whole, to be
normalised and cut by who counts or encodes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from glyphspark.llm import _vec as V

# Fixed values of the vocabulary file: its pattern, and the steps of its normaliser.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_STEPS = {"NFC", "Lowercase"}
#: Pieces from this many bytes on stay whole and are told apart by another hash.
LONG_PIECE = 200

_LETTER, _DIGIT, _MARK, _ODD, _WHOLE = 1, 2, 3, 4, 5
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[ord("'"), ord("<")]] = _ODD
_CLASS[V._WHITE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cuts_words(spec: dict) -> bool:
    """True if ``pretokens`` cuts as the tokenizer file does (else only white space may be cut at, if that)."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    kinds = {x["type"] for x in steps if not (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"})}
    pattern = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    return kinds == WORD_STEPS and pattern == WORD_PATTERN and all("<" in x["content"] for x in spec["added_tokens"])


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of the ranges, end to end."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def pretokens(data: np.ndarray, offsets: np.ndarray, words: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of all texts: a hash (of lower-case ASCII in cut pieces), first byte, end byte, and n + 1 offsets of texts in them.

    Without ``words`` every piece between ASCII white space stays whole.
    """
    n = data.size
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    if lead.size:
        odd = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)) | (data[lead] == 0xC4) & (data[lead + 1] == 0xB0)
        letter = np.where(odd, _ODD, _LETTER)
        kind[lead] = kind[lead + 1] = letter
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ink = kind != 0
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
    whole = (odd[end] > odd[start]) | (end - start >= LONG_PIECE) if words else np.ones(start.size, bool)
    if whole.any():
        kind[_ranges(start[whole], end[whole])] = _WHOLE
    change = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:-1]
    first[1:] = ink[1:] & change
    last[:-1] = ink[:-1] & change
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = V._powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(V._BYTES[np.where(kind == _LETTER, _LOWER[data], data)] * up[:n], out=total[1:])
    value = V.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(V._P))
    raw = None
    for k in np.flatnonzero(end - start >= LONG_PIECE).tolist():
        raw = raw or data.tobytes()
        value[k] = np.uint64(hash(raw[start[k] : end[k]]) & 0xFFFFFFFFFFFFFFFF)
    return value, start, end, np.searchsorted(start, offsets)


def distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of first occurrence, where each occurs first, and for every value the index of its distinct one."""
    if not value.size:
        return value, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(value).dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    top = np.maximum.accumulate(which)
    return coded.dictionary.to_numpy(), np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]])), which
