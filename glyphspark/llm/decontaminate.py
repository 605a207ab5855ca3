"""Op 9: benchmark decontamination by spaced seeds.

Fixed masks over up to ``SPAN`` words ignore some word positions, so a seed still hits where those words were substituted:
whichever words of a window differ, as many as ``SHARE`` allows, one of the masks fits between them.

1. The items' seeds (every mask at every word) are a table. A bitmap of their hashes, of bounded size, goes to the tasks,
   where it spares most of the documents' seeds the way to the join; it decides nothing.
2. The documents' seeds are joined with the items' by hash. Every hit names a diagonal on which document and item are laid;
   equal texts have the same diagonals and are joined once.
3. Diagonals meet the texts, and there a window of ``window`` words (the whole item if shorter) must agree in ``share`` of its
   words; an overlap cut short by an edge must have as many equal words.

Item tables and diagonals are broadcast where their bytes were counted and are few, and shuffled otherwise (adaptive execution
splits hot seeds). One pass over the documents for seeds and one for verdicts, however large the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._spark import checkpointed, join_counted, text_hash

SPAN = 12
#: Six words that count in each. Found by greedy search over all patterns of up to 4 different words in a window of 16 and of up
#: to 3 in one of 12 to 15; all are hit. Another ``window`` or a smaller ``share`` has no such guarantee.
MASKS = ("110100111", "1111011", "1110001011", "110001000111", "11101011", "10011111", "111101000001", "110011011")
WINDOW, SHARE = 16, 0.75
#: Bits of the bitmap at most (2 ** 25 are 4 MB), and for each seed.
MAX_BITS, BITS_A_SEED = 25, 256


def seeds(value: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the words that a mask keeps, at every word; ``number`` tells masks apart."""
    n = value.size - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            out += value[k : k + n] * V._POSITION[k]
    return V.mix(out)


def agreement(doc: np.ndarray, item: np.ndarray, start: int, window: int, share: float) -> tuple[int, int] | None:
    """Of a window of the diagonal that starts at ``start``: its best count of equal words and its length, if the count suffices.

    Where document and item overlap in fewer words than a window, but in ``SPAN`` at least, the overlap is the window.
    """
    window = min(window, item.size)
    needed = math.ceil(share * window)
    a, b = max(0, start), min(doc.size, start + item.size)
    if b - a < min(window, SPAN):
        return None
    window = min(window, b - a)  # a passage cut off by an edge needs as many equal words as a whole window
    equal = np.concatenate([[0], np.cumsum(doc[a:b] == item[a - start : b - start])])
    best = int((equal[window:] - equal[:-window]).max())
    return (best, window) if best >= needed else None


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    value, _, _, at = V.words(*V.text_bytes(texts), apart=V.PUNCTUATION)
    return value, at


def _item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, words): the items that have words, repeated rows once; words are packed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in V.slices(whole):
                value, at = _words(part.column(1))
                packed = [value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(packed, pa.binary())], ["item_id", "n", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    items = items.mapInArrow(V.releasing(run), "item_id long, n long, words binary").where("n > 0").distinct()
    return items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "n", "words")


def masks_for(short: list[int]) -> list[str]:
    """The masks of long items, and for every length of short ones all their words."""
    return [*MASKS, *("1" * n for n in short)]


def _item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(seed, item, at) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.frombuffer(packed.as_py(), np.uint64)
                own = [(k, m) for k, m in enumerate(masks) if (k < len(MASKS) if value.size >= SPAN else len(m) == value.size and k >= len(MASKS))]
                found = [seeds(value, m, k) for k, m in own]
                seed, at = np.concatenate(found), np.concatenate([np.arange(x.size) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(seed.size, item, np.int64)), pa.array(at, pa.int32())], ["seed", "item", "at"])

    return items.select("item", "words").mapInArrow(run, "seed long, item long, at int")


def _probes(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seed >> np.uint64(64 - bits)).astype(np.int64), (seed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bitmap(item_seeds: DataFrame) -> tuple[bytes, int]:
    """Both probes of all seeds, and the bits it has as a power of two; what is collected is the bitmap."""
    n = item_seeds.count()
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(max(1, n * BITS_A_SEED)))))
    high, low = F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    bit = item_seeds.select(F.explode(F.array(high, low)).alias("bit"))
    size = 1 << 15
    rows = bit.groupBy(F.floor(F.col("bit") / size).alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("map")).collect()
    out = bytearray(1 << (bits - 3))
    for r in rows:
        out[r["page"] * size // 8 : (r["page"] + 1) * size // 8] = r["map"]
    return bytes(out), bits


def _hits(texts: DataFrame, masks: list[str], bitmap: bytes, bits: int) -> DataFrame:
    """(h1, h2, seed, pos): seeds of texts that the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        for whole in batches:
            for part in V.slices(whole):
                value, at = _words(part.column(2))
                for number, mask in enumerate(masks):
                    seed = seeds(value, mask, number)
                    high, low = _probes(seed, bits)
                    near = np.flatnonzero(known[high])
                    near = near[known[low[near]]]
                    text = np.searchsorted(at, near, "right") - 1
                    inside = near + len(mask) <= at[text + 1]
                    near, text = near[inside], text[inside]
                    if near.size:
                        row = pa.array(text, pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(seed[near].view(np.int64)), pa.array(near - at[text], pa.int32())], ["h1", "h2", "seed", "pos"])

    return texts.select("h1", "h2", "text").mapInArrow(V.releasing(run), "h1 long, h2 long, seed long, pos int")


def _judged(near: DataFrame, window: int, share: float) -> DataFrame:
    """(doc_id, item_id, n_equal, n_window) of the best window of each text and item, of rows (doc_id, text, laid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in V.slices(whole):
                value, at = _words(part.column(1))
                rows: list[tuple] = []
                for k, laid in enumerate(part.column(2).to_pylist()):
                    doc = value[at[k] : at[k + 1]]
                    for x in laid:
                        item = np.frombuffer(x["words"], np.uint64)
                        best = max((got for s in x["starts"] if (got := agreement(doc, item, s, window, share))), default=None)
                        if best:
                            rows.append((k, x["item_id"], *best))
                cols = [part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "n_equal", "n_window"])

    return near.select("doc_id", "text", "laid").mapInArrow(V.releasing(run), "doc_id long, item_id long, n_equal long, n_window long")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Pairs of documents (doc_id, text) and benchmark items (item_id, text) that share a passage.

    Rows: doc_id, item_id, n_equal (equal words of the best window), n_window (its words); one row a pair, none for clean
    documents. Words are runs of letters and digits in lower case. Null or wordless texts on either side share nothing;
    an item of under ``SPAN`` words must be there whole. Rows with the same doc_id, or items with the same item_id,
    count together; a null doc_id or item_id is one like others. Other columns are ignored. An empty benchmark or table
    gives no rows.
    """
    items = checkpointed(_item_words(benchmark))
    masks = masks_for([r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect()])  # SPAN - 1 at most
    item_seeds = checkpointed(_item_seeds(items, masks))
    bitmap, bits = _bitmap(item_seeds)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("text <> ''").withColumns(dict(zip(("h1", "h2"), text_hash(F.col("text")), strict=True)))
    diagonals = join_counted(_hits(texts, masks, bitmap, bits), item_seeds, "seed", "inner").select("h1", "h2", "item", (F.col("pos") - F.col("at")).alias("start"))
    laid = diagonals.distinct().groupBy("h1", "h2", "item").agg(F.collect_list("start").alias("starts"))  # of one text and one item
    laid = join_counted(laid, items.select("item", "item_id", "words"), "item", "inner").groupBy("h1", "h2").agg(F.collect_list(F.struct("item_id", "words", "starts")).alias("laid"))
    pairs = _judged(join_counted(texts, laid, ["h1", "h2"], "inner"), window, share)
    best = F.max(F.struct("n_equal", "n_window")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_equal", "best.n_window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that share a passage with an item; rows with a null doc_id stay."""
    ids = contaminated(docs, benchmark, window, share).where("doc_id is not null").select(F.col("doc_id").alias("_gs_doc")).distinct()
    return join_counted(docs, ids, F.col("doc_id").cast("long") == F.col("_gs_doc"), "left_anti")
