"""Op 1: exact repeated substrings across documents, by multi-string Burrows-Wheeler transforms built column by column.

Of equal whole texts the smallest document's is looked at, the others are copies. Every window of ``width`` bytes has an anchor,
the smallest hash of the ``KGRAM``-byte strings in it, so that equal windows have equal anchors. Anchors that occur in several
texts are found by packed blocks (``_repeats``); the runs of windows with such an anchor are short segments of text, dealt by
anchor. Where an anchor is frequent, so that its contexts would crowd one task, the smallest hash of longer strings splits it.

In each bucket the distinct segments are the collections of a column-wise (BCR) construction: each round inserts one symbol
of every string, from its last to its first, at the place that the transform so far gives by counting symbols, and
updates the array of longest common prefixes by range minima. A symbol is a block of bytes (ten for a width of 50), and
each of the ten ways to cut a segment into blocks is a string of its own, so all byte positions are covered in a
tenth of the rounds. A collection has a bounded size, so its transform and its common prefixes stay in memory instead of
in files, and range minima are looked up in a table rather than kept in one pass. Suffixes whose common prefixes are ``width`` or longer are equal windows; the
smallest document of each decides. Segments carry one smallest and one largest
document for each block of rows, so a passage that very many documents share is a few entries; the answer returns to all
its places by a join on the segment, where adaptive execution splits hot keys. Texts are shuffled once, by their hash, and every
step that needs them reads that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._repeats import narrowed, repeats
from glyphspark.llm._spark import checkpointed, text_hash

WIDTH, KGRAM = 50, 20
#: Text bytes for each bucket (about); segments that a task packs before it passes them on.
BUCKET_BYTES, BLOCK_SEGMENTS = 6 << 20, 400_000
#: Symbols of one collection at most (but for one anchor's segments), and of a block's bytes.
COLLECTION, MAX_BLOCK = 60_000, 10
#: An anchor that this many different texts have (about) is frequent; told by a sample of texts, in which it is at least so often;
#: bits of the frequent anchors' bitmap as a power of two.
HOT_SEGMENTS, SAMPLE_TEXTS, MIN_SAMPLED, HOT_BITS = 20_000, 5_000, 8, 22
_END = 0xFFFF


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: x.size - (span - have)], x[span - have :]) if have < span else x


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash of every window inside a text: hash, first byte of the window, text."""
    kgram = min(KGRAM, width)
    grams = V.starts(data, kgram, total)
    span = width - kgram + 1
    if grams.size < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding_min(grams, span)
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(n.size), n)
    at = np.arange(text.size) - np.repeat(np.cumsum(n) - n, n) + offsets[text]
    return least[at], at, text


def spread(hashes: np.ndarray) -> np.ndarray:
    """Anchors are minima and so small numbers; dealt by hash they need all bits again."""
    return V.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))


class RangeMin:
    """Minima over ranges of a byte array: inside blocks by running minima, across blocks by a table of powers of two."""

    SIDE = 32

    def __init__(self, x: np.ndarray):
        s = self.SIDE
        rows = np.full((-(-x.size // s), s), 255, np.uint8)
        rows.reshape(-1)[: x.size] = x
        self.flat = rows.reshape(-1)
        self.left = np.minimum.accumulate(rows, axis=1).reshape(-1)
        self.right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [self.left[s - 1 :: s]]
        while 2 << (len(self.table) - 1) <= rows.shape[0]:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum from a to b, both inclusive, a <= b."""
        s = self.SIDE
        x, y = a // s, b // s
        out = np.minimum(self.right[a], self.left[b])
        gap = y - x - 1
        for level, table in enumerate(self.table):
            k = np.flatnonzero((gap >= 1 << level) & (gap < 2 << level))
            if k.size:
                out[k] = np.minimum(out[k], np.minimum(table[x[k] + 1], table[y[k] - (1 << level)]))
        near = np.flatnonzero(gap < 0)
        low, high, best = a[near], b[near], self.flat[a[near]]
        while near.size:
            low = low + 1
            go = low <= high
            out[near[~go]] = best[~go]
            near, low, high, best = near[go], low[go], high[go], best[go]
            best = np.minimum(best, self.flat[low])
        return out


def collection_bwt(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes of all suffixes of the strings (rows of ``symbols``, right-aligned), built column by column.

    Order: the empty suffixes by string, then all suffixes; ends differ from one another. The symbol before a whole
    string is ``_END``. A common prefix counts up to 254.
    """
    m, columns = symbols.shape
    bwt, lcp = symbols[:, -1].copy(), np.zeros(m, np.uint8)
    place = np.arange(m)
    live = np.arange(m)
    for j in range(1, columns + 1):
        keep = lengths[live] >= j
        live, place = live[keep], place[keep]
        if not live.size:
            break
        order = np.argsort(bwt, kind="stable")
        own = np.full(bwt.size, -1, np.int32)
        own[place] = np.arange(live.size, dtype=np.int32)
        who = own[order]
        rank = np.flatnonzero(who >= 0)
        who = who[rank]
        live, at = live[who], order[rank]
        # common prefixes with the neighbours that begin with the same symbol
        symbol = bwt[at]
        before, after = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, order.size - 1)]
        has_before = (rank > 0) & (bwt[before] == symbol)
        has_after = (rank < order.size - 1) & (bwt[after] == symbol)
        least = RangeMin(lcp)
        up, down = np.zeros(rank.size, np.uint8), np.zeros(rank.size, np.uint8)
        up[has_before] = np.minimum(least(before[has_before] + 1, at[has_before]), 253) + 1
        down[has_after] = np.minimum(least(at[has_after] + 1, after[has_after]), 253) + 1
        # a new suffix goes where its symbol's count puts it, behind the empty ones
        place = m + rank
        fresh = np.where(lengths[live] > j, symbols[live, columns - 1 - np.minimum(j, columns - 1)], _END).astype(np.uint16)
        stay = np.ones(bwt.size + rank.size, bool)
        stay[place] = False
        wider = np.empty(stay.size, np.uint16)
        wider[stay], wider[place] = bwt, fresh
        bwt, wider = wider, np.empty(stay.size, np.uint8)
        wider[stay] = lcp
        follow = place + 1
        inside = follow < wider.size
        wider[follow[inside]] = down[inside]  # the one behind, whether old or new
        wider[place] = up
        lcp = wider
    return bwt, lcp


def equal_windows(symbols: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every window of ``width`` symbols of the strings: string, first symbol, smallest ``low`` and largest ``high`` of the strings with an equal window."""
    m, columns = symbols.shape
    bwt, lcp = collection_bwt(symbols, lengths)
    order = np.argsort(bwt, kind="stable")
    onward = np.empty(order.size, np.int64)
    onward[order] = np.arange(order.size) + m
    group = np.cumsum(lcp < width)
    where, string, first = [], [], []
    live, place = np.arange(m), np.arange(m)
    for j in range(1, columns + 1):
        keep = lengths[live] >= j
        live, place = live[keep], onward[place[keep]]
        if j >= width:
            where.append(group[place])
            string.append(live)
            first.append(lengths[live] - j)
    where, string, first = np.concatenate(where), np.concatenate(string), np.concatenate(first)
    by = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], where[by][1:] != where[by][:-1]]))
    which = np.empty(where.size, np.int64)
    which[by] = np.repeat(np.arange(cuts.size), np.diff(np.append(cuts, where.size)))
    return string, first, np.minimum.reduceat(low[string[by]], cuts)[which], np.maximum.reduceat(high[string[by]], cuts)[which]


def aligned(codes: np.ndarray, start: np.ndarray, lengths: np.ndarray, step: int = 1) -> np.ndarray:
    """Strings as right-aligned rows: ``lengths`` symbols each, every ``step``-th of ``codes`` from ``start``."""
    columns = int(lengths.max())
    at = (start + step * lengths)[:, None] - step * np.arange(columns, 0, -1)[None, :]
    return np.where(at >= start[:, None], codes[np.maximum(at, 0)], _END).astype(np.uint16)


def segment_windows(body: np.ndarray, start: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``equal_windows`` of segments of bytes: segment, first byte, smallest ``low``, largest ``high``."""
    for block in (b for b in range(min(MAX_BLOCK, width), 0, -1) if width % b == 0):
        blocks = V.starts(body, block)
        phase = np.tile(np.arange(block), start.size)
        segment = np.repeat(np.arange(start.size), block)
        count = (length[segment] - phase) // block
        begin = start[segment] + phase
        used = np.zeros(blocks.size, bool)
        used[np.repeat(begin - block * (np.cumsum(count) - count), count) + block * np.arange(int(count.sum()))] = True
        _, code = np.unique(blocks[used], return_inverse=True)
        if code.max() < _END:
            break  # else shorter blocks, of which there are fewer; single bytes always fit
    codes = np.zeros(blocks.size, np.uint16)
    codes[used] = code
    string, first, least, most = equal_windows(aligned(codes, begin, count, block), count, low[segment], high[segment], width // block)
    return segment[string], phase[string] + block * first, least, most


def collections(anchor: np.ndarray, length: np.ndarray) -> Iterator[slice]:
    """Ranges of segments, whole anchors each, of ``COLLECTION`` symbols at most where anchors allow it."""
    edge = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), anchor.size)
    total = np.concatenate([[0], np.cumsum(length)])
    at = 0
    while at < edge.size - 1:
        to = max(at + 1, int(np.searchsorted(total[edge], total[edge[at]] + COLLECTION, "right")) - 1)
        yield slice(int(edge[at]), int(edge[to]))
        at = to


def _hot(hashes: np.ndarray, hot: bytes) -> np.ndarray:
    """Whether anchors are in the bitmap of frequent ones."""
    bits = (len(hot) * 8).bit_length() - 1
    at = (spread(hashes) >> np.uint64(64 - bits)).astype(np.int64)
    return (np.frombuffer(hot, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def frequent_anchors(able: DataFrame, classes: DataFrame, width: int) -> bytes:
    """A bitmap of anchors that about ``HOT_SEGMENTS`` different texts or more have, told by a sample of texts.

    It decides only how finely windows are dealt, not what is found: a frequent phrase has as many contexts as texts, which would
    all meet in one task.
    """
    n = classes.count()
    share = min(1.0, SAMPLE_TEXTS / max(n, 1))
    drawn = F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20))
    firsts = classes.where(drawn).select("h1", "h2", F.col("first").alias("doc_id"))  # about SAMPLE_TEXTS rows
    texts = able.where(drawn).join(F.broadcast(firsts), ["h1", "h2", "doc_id"], "left_semi").select("text")
    span = width - min(KGRAM, width) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch):
                hashes, _, text = anchors(*V.text_bytes(part.column(0)), width)
                new = np.ones(hashes.size, bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                value, _ = V.per_text_unique(hashes[new], np.searchsorted(text[new], np.arange(part.num_rows + 1)))
                yield pa.RecordBatch.from_arrays([pa.array((spread(value) >> np.uint64(64 - HOT_BITS)).astype(np.int32), pa.int32())], ["bit"])

    least = max(MIN_SAMPLED, int(HOT_SEGMENTS * share))
    page = 1 << 15
    found = texts.mapInArrow(V.releasing(run), "bit int").groupBy("bit").count().where(F.col("count") >= least) if span > 1 else None
    out = bytearray(1 << (HOT_BITS - 3))
    for r in found.groupBy(F.floor(F.col("bit") / page).alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % page).alias("map")).collect() if found is not None else ():
        out[r["page"] * page // 8 : (r["page"] + 1) * page // 8] = r["map"]
    return bytes(out)


def _packed(base: DataFrame) -> DataFrame:
    """``base`` (doc_id, text, h1, h2) with compressed texts: less to shuffle and to sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False, write_dict_id=False).compress
        for batch in batches:
            data, offsets = V.text_bytes(batch.column(1))
            body, at = memoryview(data), offsets.tolist()
            packed = [press(body[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(np.diff(offsets)), batch.column(2), batch.column(3)], ["doc_id", "packed", "size", "h1", "h2"])

    return base.mapInArrow(V.releasing(run), "doc_id long, packed binary, size long, h1 long, h2 long")


def _opened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc, tag, packed, size, values) in slices of bounded text bytes, opened: (doc, tag, text as bytes, values). No text counts as empty."""
    size = batch.column(3).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(np.where(batch.column(2).is_null().to_numpy(zero_copy_only=False), 0, size))])
    press = zstandard.ZstdDecompressor()
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(total, total[row] + V.SLICE_BYTES, "right")) - 1)
        part = batch.slice(row, to - row)
        texts = [b"" if x is None else press.decompress(x) for x in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.large_binary()), part.column(4)], ["doc", "tag", "text", "values"])
        row = to


def _segments(batch: pa.RecordBatch, buckets: int, width: int, hot: bytes) -> Iterator[tuple]:
    """Segments of slices of (doc, tag, packed text, its bytes, values): bytes of the slice, first byte, length, key, anchor, row and place in its text.

    A segment is a run of windows with the same anchor. Windows with a frequent anchor are told apart by a longer one as well.
    """
    span = width - min(KGRAM, width) + 1
    for part in _opened(batch):
        data, offsets = V.text_bytes(part.column(2))
        total = V.prefix(data)
        hashes, at, text = anchors(data, offsets, width, total)
        if not hashes.size:
            continue
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])
        packed = [x or b"" for x in part.column(3).to_pylist()]
        wanted = np.frombuffer(b"".join(packed), np.uint64)
        owner = np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed]).astype(np.uint64)
        runs = np.flatnonzero(new)
        tied = V.mix(narrowed(spread(hashes[runs]), buckets) ^ V.mix(text[runs].astype(np.uint64)))
        hit = np.isin(tied, V.mix(wanted ^ V.mix(owner)))
        live = np.flatnonzero(np.repeat(hit, np.diff(np.append(runs, hashes.size))))
        if not live.size:
            continue
        hashes, at, text = hashes[live], at[live], text[live]
        down = V._powers(data.size)[1]
        often = np.flatnonzero(_hot(hashes, hot))
        if often.size:
            size, begin = width - width // 3, at[often]
            longer = np.full(often.size, np.iinfo(np.uint64).max, np.uint64)
            for k in range(width // 3 + 1):  # the strings of this size that begin in the window
                longer = np.minimum(longer, V.mix((total[begin + k + size] - total[begin + k]) * down[begin + k]))
            hashes[often] = V.mix(hashes[often] ^ V.mix(longer))
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]) | (live[1:] != live[:-1] + 1)])
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], hashes.size)
        pieces = -(-(ends - runs) // span)  # long runs of one anchor (periodic text) in parts
        run = np.repeat(np.arange(runs.size), pieces)
        first = runs[run] + (np.arange(run.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * span
        length = np.minimum(first + span, ends[run]) - first + width - 1
        start = at[first]
        key = V.mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64) * np.uint64(V._P))
        yield part, data, start, length, key, spread(hashes[first]), text[first], start - offsets[text[first]]


def _verdicts(texts: DataFrame, buckets: int, width: int, hot: bytes) -> DataFrame:
    """(key, anchor, w0, w1, low): windows w0..w1 of a segment occur in document ``low`` first, and in another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            key, anchor, length, doc = (np.concatenate([h[k] for h in held]) for k in range(4))
            body, base = np.concatenate([h[4] for h in held]), np.concatenate([[0], np.cumsum([h[4].size for h in held])])
            start = np.concatenate([h[5] + b for h, b in zip(held, base[:-1], strict=True)])
            held.clear()
            bucket = (anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.lexsort((doc, key, anchor))
            key, anchor, doc = key[order], anchor[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])]))
            last = np.append(first[1:], key.size) - 1
            low, high, key, anchor = doc[first], doc[last], key[first], anchor[first]
            start, length, bucket = start[order[first]], length[order[first]], bucket[order[first]]
            rows = []
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                x = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    n = length[x]
                    take = np.repeat(start[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    packed = [zstandard.compress(y.tobytes(), 1) for y in (anchor[x], n.astype(np.int32), low[x], high[x] - low[x], body[take])]
                    rows.append((b, key[x].tobytes(), *packed))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], ["bucket", "key", "anchor", "n", "low", "high", "body"])

        size = 0
        for batch in batches:
            for part, data, start, length, key, anchor, row, _ in _segments(batch, buckets, width, hot):
                if key.size:
                    doc = part.column(0).to_numpy(zero_copy_only=False)[row]
                    held.append((key, anchor, length, doc, data, start))
                    size += key.size + data.size // 64
                if size >= BLOCK_SEGMENTS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in ("key", "anchor", "n", "low", "high", "body")}
        opened = lambda c, kind: np.frombuffer(b"".join(zstandard.decompress(x) for x in cols[c]), kind)
        key, anchor = np.frombuffer(b"".join(cols["key"]), np.uint64), opened("anchor", np.uint64)
        length, low, body = opened("n", np.int32).astype(np.int64), opened("low", np.int64), opened("body", np.uint8)
        high = low + opened("high", np.int64)
        start = np.cumsum(length) - length
        order = np.lexsort((key, anchor))
        head = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]))
        low, high = np.minimum.reduceat(low[order], head), np.maximum.reduceat(high[order], head)
        one = order[head]
        key, anchor, length, start = key[one], anchor[one], length[one], start[one]
        # an anchor with all its segments in one document has nothing to compare
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        several = np.repeat(np.minimum.reduceat(low, edge) != np.maximum.reduceat(high, edge), np.diff(np.append(edge, anchor.size)))
        key, anchor, length, start, low, high = (x[several] for x in (key, anchor, length, start, low, high))
        if not key.size:
            return pa.table({"key": pa.array([], pa.int64()), "anchor": pa.array([], pa.int32()), "w0": pa.array([], pa.int32()), "w1": pa.array([], pa.int32()), "low": pa.array([], pa.int64())})
        take = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        body, start = body[take], np.cumsum(length) - length
        found = []
        for x in collections(anchor, length):
            own = body[start[x.start] : start[x.stop - 1] + length[x.stop - 1]]
            string, first, least, most = segment_windows(own, start[x] - start[x.start], length[x], low[x], high[x], width)
            found.append((string + x.start, first, least, most))
        string, first, least, most = (np.concatenate([f[k] for f in found]) for k in range(4))
        shared = least != most
        string, first, least = string[shared], first[shared], least[shared]
        order = np.lexsort((first, string))
        string, first, least = string[order], first[order], least[order]
        new = np.ones(string.size, bool)
        new[1:] = (string[1:] != string[:-1]) | (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], string.size)[: a.size] - 1
        return pa.table({"key": pa.array(key[string[a]].view(np.int64)), "anchor": pa.array(_half(anchor[string[a]])), "w0": pa.array(first[a], pa.int32()), "w1": pa.array(first[b], pa.int32()), "low": pa.array(least[a], pa.int64())})

    packed = texts.mapInArrow(V.releasing(pack), "bucket int, key binary, anchor binary, n binary, low binary, high binary, body binary")
    return packed.groupBy("bucket").applyInArrow(meet, "key long, anchor int, w0 int, w1 int, low long")


def _places(texts: DataFrame, buckets: int, width: int, hot: bytes) -> DataFrame:
    """(key, anchor, doc, tag, pos): where segments stand; an anchor is its lower half, a tag some bits of the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, _, key, anchor, row, pos in _segments(batch, buckets, width, hot):
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(_half(anchor)), part.column(0).take(take), part.column(1).take(take), pa.array(pos, pa.int32())], ["key", "anchor", "doc", "tag", "pos"])

    return texts.mapInArrow(V.releasing(run), "key long, anchor int, doc long, tag int, pos int")


def _half(anchor: np.ndarray) -> np.ndarray:
    return anchor.astype(np.uint32).view(np.int32)


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, tag, spans): starts and ends of maximal runs, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                s = np.sort(np.array([(r["a"], r["b"]) for r in x.as_py()], np.int64), axis=0)  # ends sorted by themselves give the same union
                cut = np.concatenate([[True], s[1:, 0] > s[:-1, 1]])
                out.append(np.column_stack([s[cut, 0], s[np.append(cut[1:], True), 1]]).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc", "tag", "spans"])

    gathered = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("s"))  # of one text
    return gathered.mapInArrow(run, "doc long, tag int, spans array<long>")


def repeated_spans(base: DataFrame, packed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Byte spans of ``base`` (doc_id, text, h1, h2), which ``packed`` has compressed, that a ``width``-byte string covers which starts in a smaller document too.

    Rows: h1, found: for each text of the hash h1 (one, but for collisions) its h2, the smallest document with it (``first``, in
    which the spans count; all others are copies), and spans (start, end, start, end, ... of maximal runs, or null). Only texts
    that are repeated or have something to cut.
    """
    spark = base.sparkSession
    able = base.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    classes = able.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k"), F.max(F.octet_length("text").cast("long")).alias("size"))
    classes = checkpointed(classes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(parts, -(-(classes.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES)))

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in V.slices(batch):
            hashes, _, text = anchors(*V.text_bytes(part.column(1)), width)
            new = np.ones(hashes.size, bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, text = spread(hashes[new]), text[new]
            value, at = V.per_text_unique(hashes, np.searchsorted(text, np.arange(part.num_rows + 1)))
            yield np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(at)), value

    hot = frequent_anchors(able, classes, width)
    wanted = repeats(able.select("h1", "text"), pairs, buckets, with_values=True).select(F.col("owner").alias("h1"), "values")
    firsts = classes.select("h1", F.col("h2").alias("_h2"), "first")
    # all three by h1, so that texts are laid out once; what the second hash or the document tells apart is left empty
    texts = packed.join(wanted.hint("shuffle_merge"), "h1").join(firsts.hint("shuffle_merge"), "h1")
    own = (F.col("doc_id") == F.col("first")) & (F.col("h2") == F.col("_h2"))
    texts = texts.select(F.col("doc_id").alias("doc"), _tag(F.col("h2")).alias("tag"), F.when(own, F.col("packed")).alias("packed"), "size", "values")
    verdicts, places = _verdicts(texts, buckets, width, hot), _places(texts, buckets, width, hot)
    cuts = places.join(verdicts.hint("shuffle_merge"), ["key", "anchor"]).where("doc > low").select("doc", "tag", (F.col("pos") + F.col("w0")).cast("long").alias("a"), (F.col("pos") + F.col("w1") + width).cast("long").alias("b"))
    spans = _merged(cuts).withColumnRenamed("doc", "first")
    told = classes.withColumn("tag", _tag(F.col("h2"))).join(spans.hint("shuffle_merge"), ["first", "tag"], "left").where("k > 1 or spans is not null")
    return told.groupBy("h1").agg(F.collect_list(F.struct("h2", "first", "spans")).alias("found"))  # texts of one hash


def _tag(h2: F.Column) -> F.Column:
    """Some bits of a text's hash, which tell apart texts of the same document."""
    return h2.bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def dedup_substrings(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Remove from every text of ``docs`` (doc_id, text) the bytes covered by repeats of ``width`` bytes from smaller documents.

    Rows: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes, and if asked for
    ``kept`` (binary). Strings are judged on the input, not on what is left. A null or empty text has nothing to remove. Rows
    with a null doc_id are neither compared nor cut. Rows with the same doc_id are never compared with each other. Rows
    repeat as the input's do, other columns are ignored, and an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = text_hash(text)
    doc = F.col("doc_id").cast("long")
    base = docs.select(doc.alias("doc_id"), text.alias("text"), h1.alias("h1"), F.when(doc.isNull(), F.lit(0).cast("long")).otherwise(h2).alias("h2"))
    packed = _packed(base).where("h1 is not null")  # always true; an inner join asks for it, and only equal exchanges are shared
    # the exchange of texts by their hash serves this join and those inside
    joined = packed.join(repeated_spans(base, packed, width).hint("shuffle_merge"), "h1", "left")
    own = F.get(F.filter("found", lambda x: x["h2"] == F.col("h2")), 0)
    joined = joined.select("doc_id", "packed", "size", own["spans"].alias("spans"), F.coalesce(F.col("doc_id") > own["first"], F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for packed, spans, copy in zip(*[batch.column(k).to_pylist() for k in (1, 3, 4)], strict=True):
                body = press.decompress(packed)
                spans = [0, len(body)] if copy else spans or []
                kept = b"".join(body[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(body)], strict=True))
                for to, x in zip(rows, (len(body), len(body) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    to.append(x)
            cols = [batch.column(0), *[pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(cols if with_text else cols[:-1], names if with_text else names[:-1])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
