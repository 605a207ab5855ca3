"""Op 12: near duplicates by SimHash fingerprints, compared as bit planes.

1. Shingle hashes are made by the JVM; a text's fingerprint has the bits that more than half of them set.
2. Distinct fingerprints are dealt by what two near ones must share: of ``radius`` + 2 pieces, two at least are equal. A bucket of
   more than ``MAX_BUCKET`` fingerprints is dealt again by pieces of the bits that are left, until the bits run out, so no
   bucket is compared whole by one task however many near copies there are. Bucket sizes are partial sums.
3. A task lays its fingerprints down as bit planes, sorted by bucket, and compares them with themselves shifted by 1, 2, 3
   ... places: 64 pairs a word, two planes a step through carry-save adders. Words whose pairs all exceed the radius are left.
4. Pairs become, for each bucket, links to the smallest fingerprint of a component; components are joined over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._spark import checkpointed, connected_components, join_counted, let

BITS, RADIUS, WORDS = 64, 2, 3
#: Fingerprints that one bucket compares, and that one task holds (about).
MAX_BUCKET, TASK_ROWS = 4096, 400_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: Column, width: int = WORDS) -> Column:
    """XXH64 (seed 42) of every ``width`` consecutive words, joined by spaces; of all words where there are fewer; none without words."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")

    def hashes(w: Column) -> Column:
        each = F.transform(F.slice(w, 1, F.greatest(F.least(F.size(w), F.lit(1)), F.size(w) - (width - 1))), lambda x, i: F.xxhash64(F.array_join(F.slice(w, i + 1, width), " ")))
        return each

    return let(words, hashes)


#: The eight bits of a byte, a byte for each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(_U).ravel()


def majorities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each list of 64-bit hashes the bits that over half of them set (0 for an empty list)."""
    count = np.diff(offsets)
    chunks = -(-count // 255)  # bytes count up to 255
    owner = np.repeat(np.arange(count.size), chunks)
    first = np.arange(owner.size) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = offsets[:-1][owner] + 255 * first
    out = np.zeros(count.size, _U)
    if not starts.size:
        return out
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
    full = np.flatnonzero(count > 0)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS).astype(np.int64), (np.cumsum(chunks) - chunks)[full], axis=0)
    out[full] = np.packbits(sums * 2 > count[full, None], axis=1, bitorder="little").view(_U).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp is the fingerprint's 64 bits as a long, 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(_U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majorities(hashes, offsets - offsets[0]).view(np.int64), pa.int64())], ["doc_id", "fp"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.coalesce("text", F.lit("")), width).alias("h"))
    return hashed.mapInArrow(V.releasing(run), "doc_id long, fp long")


class Planes:
    """Fingerprints as bit planes, and which of them are near to the one ``shift`` places further on in the same bucket."""

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        """Rows of a bucket stand together, large buckets first."""
        self.n = fp.size
        self.words = -(-self.n // 64)
        pack = self._pack
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), self.n)
        self.sizes = np.diff(cuts)
        self.ends = np.repeat(cuts[1:], self.sizes)
        neighbours = self.ends[:-1] > np.arange(1, self.n)
        step = (fp[1:] ^ fp[:-1])[neighbours]
        # a plane that no neighbours of a bucket differ in is equal all over every bucket; the liveliest are compared first
        lively = [int(np.count_nonzero(step >> _U(b) & _U(1))) for b in range(BITS)]
        order = [b for b in sorted(range(BITS), key=lambda b: -lively[b]) if lively[b]]
        self.planes = [np.append(pack((fp >> _U(b) & _U(1)).astype(bool)), [_U(0), _U(0)]) for b in order]

    def _pack(self, bit: np.ndarray) -> np.ndarray:
        return np.packbits(np.append(bit, np.zeros(-bit.size % 64, bool)), bitorder="little").view(_U)

    def _ahead(self, plane: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """The words ``at`` of a plane, as they stand ``shift`` places further on."""
        q, r = divmod(shift, 64)
        low = plane[np.minimum(at + q, self.words)]
        return low if not r else low >> _U(r) | plane[np.minimum(at + q + 1, self.words)] << _U(64 - r)

    def near(self, shift: int, radius: int) -> np.ndarray:
        """Places i whose fingerprint and that of place i + shift, in the same bucket, differ in ``radius`` bits at most."""
        some = int(self.sizes[: np.searchsorted(-self.sizes, -shift, "left")].sum())  # rows of buckets with more than ``shift`` rows
        gone = ~self._pack(self.ends[:some] > np.arange(shift, some + shift))
        live = np.flatnonzero(gone != _ALL)
        gone = gone[live]
        # counters begin so that one more than the radius overflows
        size = max(1, radius.bit_length())
        begin = (1 << size) - 1 - radius
        counters = [np.full(live.size, _ALL if begin >> k & 1 else _U(0), _U) for k in range(size)]
        for k in range(0, len(self.planes), 2):
            if not live.size:
                break
            x, y = ((p[live] ^ self._ahead(p, live, shift)) for p in (self.planes[k], self.planes[k + 1] if k + 1 < len(self.planes) else np.zeros(self.words + 2, _U)))
            ones = counters[0]
            carry = (ones & x) | (y & (ones ^ x))
            counters[0] = ones ^ x ^ y
            for level in range(1, size):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            gone |= carry
            left = gone != _ALL
            if np.count_nonzero(left) < 0.75 * live.size:
                live, gone, counters = live[left], gone[left], [c[left] for c in counters]
        hit = np.unpackbits((~gone).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        word, bit = np.nonzero(hit)
        return live[word] * 64 + bit


def linked(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the first place of its component within its bucket; rows of a bucket stand together, large buckets first."""
    root = np.arange(fp.size)
    if fp.size < 2:
        return root
    planes = Planes(fp, bucket)
    for shift in range(1, int(planes.sizes[0])):
        a = planes.near(shift, radius)
        while a.size:
            x, y = root[a], root[a + shift]
            open_ = x != y
            if not open_.any():
                break
            a = a[open_]
            x, y = x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, flat := root[root]):
                root = flat
    return root


def _pieces(width: int, radius: int) -> tuple[int, list[tuple[int, int]]]:
    """Bits of a piece, and the pairs of pieces that may be equal."""
    return -(-width // (radius + 2)), list(combinations(range(radius + 2), 2))


def _dealt(keys: DataFrame, width: int, radius: int) -> tuple[DataFrame, int]:
    """``keys`` (fp, bucket, rest) once for each pair of pieces of the ``width`` bits of rest: smaller buckets, and the bits still left."""
    size, pairs = _pieces(width, radius)
    mask = F.lit((1 << size) - 1).cast("long")
    piece = lambda k: F.shiftrightunsigned("rest", k * size).bitwiseAND(mask)
    rows = []
    for kind, (i, j) in enumerate(pairs):
        others = [k for k in range(radius + 2) if k not in (i, j)]
        rest = F.lit(0).cast("long")
        for at, k in enumerate(others):
            rest = rest.bitwiseOR(F.shiftleft(piece(k), at * size))
        rows.append(F.struct(F.xxhash64("bucket", F.lit(kind), piece(i), piece(j)).alias("bucket"), rest.alias("rest")))
    return keys.select("fp", F.inline(F.array(*rows))), radius * size


def near_links(classes: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET, task_rows: int = TASK_ROWS) -> DataFrame:
    """(u, v) that connect all of the distinct fingerprints ``classes`` (fp) that differ in ``radius`` bits at most."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(table: pa.Table) -> pa.Table:
        fp, bucket = (table[c].to_numpy().view(_U) for c in ("fp", "bucket"))
        _, place, size = np.unique(bucket, return_inverse=True, return_counts=True)
        order = np.lexsort((fp, place, -size[place]))
        fp, bucket = fp[order], bucket[order]
        root = linked(fp, bucket, radius)
        more = np.flatnonzero(root != np.arange(root.size))
        return pa.table({"u": pa.array(fp[more].view(np.int64)), "v": pa.array(fp[root[more]].view(np.int64))})

    keys, width = _dealt(classes.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest")), BITS, radius)
    links = None
    while True:
        keys = checkpointed(keys)
        sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
        large = checkpointed(sizes.where(F.col("size") > max_bucket).select("bucket")) if 1 << width > max_bucket else None
        again = large is not None and large.limit(1).count() > 0
        ready = join_counted(keys, large, "bucket", "left_anti") if again else keys
        bins = max(parts, -(-keys.count() // task_rows))
        found = ready.select("fp", "bucket", F.pmod(F.xxhash64("bucket", F.lit("bin")), F.lit(bins)).alias("bin")).groupBy("bin").applyInArrow(compared, "u long, v long")
        links = found if links is None else links.union(found)
        if not again:
            return links
        keys, width = _dealt(join_counted(keys, large, "bucket", "left_semi"), width, radius)


def simhash_components(docs: DataFrame, radius: int = RADIUS, width: int = WORDS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Components of ``docs`` (doc_id, text) under links between fingerprints that differ in ``radius`` bits at most.

    Rows, one for each row of ``docs``: doc_id, fingerprint (16 lowercase hexadecimal digits), component_id (smallest doc_id reachable
    by links, itself included). A null, empty or wordless text has fingerprint zero and links like any other; a text of fewer words than
    ``width`` has one shingle. Rows are the nodes: repeated rows share their fingerprint, rows with the same doc_id and other
    texts are nodes of their own. A row with a null doc_id links like others, and no component is named after it (null if no other
    row is in it). Other columns are ignored; an empty table gives an empty one.
    """
    rows = checkpointed(fingerprints(docs, width))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    near = connected_components(near_links(classes, radius, max_bucket))
    named = classes.join(near.withColumnRenamed("node", "fp"), "fp", "left").where("copies > 1 or component is not null").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = checkpointed(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id", F.lit(True).alias("named"))
    out = join_counted(rows, named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
