"""NumPy kernels shared by the text operators: Arrow text columns as byte buffers, and rolling hashes.

Everything works on one slice of an Arrow batch at a time (``slices`` bounds its bytes), so memory follows
the slice and the longest single text, not the partition.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one pass of a kernel takes (a longer single text is one slice).
SLICE_BYTES = 1 << 19
WORDS_PER_SHINGLE = 5
#: Words from this many bytes on have another hash: different words of some 1,000 letters can share any polynomial one modulo 2^64.
LONG_WORD = 200

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)


def release() -> None:
    """Give freed memory back to the system: Python workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """A kernel over batches that releases memory when it ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_P))
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_POSITION = mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
_power_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^n and P^-0..P^-n modulo 2^64."""
    have = _power_cache.get("up")
    if have is None or have.size <= n:
        size = max(n + 1, 1 << 20)
        for key, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _power_cache[key] = np.multiply.accumulate(steps)
    return _power_cache["up"][: n + 1], _power_cache["down"][: n + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and their n + 1 offsets. A null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.type != pa.large_binary() else column.fill_null(b"")
    _, at, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    start, end = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8, end - start, start) if data is not None and end > start else np.zeros(0, np.uint8)
    return body, offsets - start


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` text bytes, or of one row where a text is longer."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, batch.num_rows
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to


#: Separators for words of letters and digits only: every other ASCII character.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without a byte of ``apart``, ASCII white space by default) of all texts: hash, first byte, end byte, and n + 1 offsets of texts in words."""
    n = data.size
    ink = ~apart[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = ink[begins]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = ink[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum((_BYTES_LOWER if lower else _BYTES)[data] * up[:n], out=total[1:])
    value = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(_P))
    for k in np.flatnonzero(end - start >= LONG_WORD):
        word = data[start[k] : end[k]].tobytes()
        value[k] = xxhash.xxh64_intdigest(word.lower() if lower else word)
    return value, start, end, np.searchsorted(start, offsets)


def shingles(value: np.ndarray, at: np.ndarray, width: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a text (all its words where it has fewer), and n + 1 offsets of texts in them."""
    count = np.diff(at)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(offsets[-1]), _U)
    if value.size >= width:
        window = np.zeros(value.size - width + 1, _U)
        for k in range(width):
            window += value[k : value.size - width + 1 + k] * _POSITION[k]
        text = np.repeat(np.arange(count.size), made)
        start = np.arange(out.size) - offsets[text] + at[text]
        whole = count[text] >= width
        out[whole] = mix(window[start[whole]])
    for text in np.flatnonzero((count > 0) & (count < width)):
        few = value[at[text] : at[text + 1]]
        out[offsets[text]] = mix(np.array([int((few * _POSITION[: few.size]).sum()) + few.size], _U) ^ _U(_P))[0]
    return out, offsets


def per_text_unique(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending within a text, and the n + 1 offsets of texts in them."""
    text = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    keep = np.ones(value.size, bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=offsets.size - 1))])


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of the buffer's beginnings, from which hashes of any stretch are made."""
    total = np.zeros(data.size + 1, _U)
    np.cumsum(_BYTES[data] * _powers(data.size)[0][: data.size], out=total[1:])
    return total


def starts(data: np.ndarray, width: int, total: np.ndarray | None = None) -> np.ndarray:
    """Rolling hashes of every ``width`` bytes of the buffer (texts not told apart); ``total`` is its ``prefix``, if known."""
    n = data.size
    if n < width:
        return np.zeros(0, _U)
    total = prefix(data) if total is None else total
    return mix((total[width:] - total[:-width]) * _powers(n)[1][: n - width + 1])
