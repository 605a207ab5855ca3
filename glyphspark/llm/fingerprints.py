"""Op 6: document fingerprints as bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles. Sketches of parts merge by taking the k
smallest of their union; two sketches estimate resemblance, containment and the number of distinct shingles,
exactly where the texts have at most k.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._spark import checkpointed

K = 128
_TOP = float(1 << 64)


def sketches(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """Bottom-k sketches of texts: ascending distinct 64-bit hashes, k at most."""
    out: list[np.ndarray] = []
    for part in V.slices(pa.RecordBatch.from_arrays([column], ["text"])):
        data, offsets = V.text_bytes(part.column(0))
        value, _, _, at = V.words(data, offsets)
        value, at = V.shingles(value, at)
        value, at = V.per_text_unique(value, at)
        out += [value[at[i] : min(at[i] + k, at[i + 1])] for i in range(at.size - 1)]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two texts' shingles."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact if the union has at most k shingles. Two empty sketches resemble fully."""
    both = merge(a, b, k)
    if not both.size:
        return 1.0
    return float(np.isin(np.intersect1d(a, b, True), both).sum()) / both.size


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(a.size) if a.size < k else (k - 1) / ((float(a[-1]) + 1) / _TOP)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has (1 if the first has none)."""
    if not a.size:
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def text_of(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def of_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint of every text of ``docs`` (doc_id, text): doc_id, n_chars, fingerprint (base64 of k hashes at most). Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([text_of(x) for x in sketches(b.column(1), k)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).cast("long").alias("n_chars")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


#: Groups whose sketches a task keeps before it passes them on.
HELD_GROUPS = 20_000


def merged(sketched: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, parts, fingerprint, n_distinct): the sketch of the union of each group's ``fingerprint`` rows, and its distinct shingles.

    Parts of a text, or the texts of a source, give the sketch that the whole would have. Each task merges what it has of a group
    first, so a group reaches the task that ends it as a sketch or a few from each task, however many rows it has. Nulls of ``by``
    are a group; null fingerprints count as parts without shingles; an empty table gives an empty one.
    """
    kinds = [(by, sketched.schema[by].dataType.simpleString()), ("parts", "long"), ("fingerprint", "string")]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds)

    def together(keys: list, parts: list, prints: list, held: dict) -> None:
        for key, n, text in zip(keys, parts, prints, strict=True):
            own = of_text(text or "")
            before = held.get(key)
            held[key] = (before[0] + n, merge(before[1], own, k)) if before else (n, own[:k])

    def table(held: dict, like: pa.DataType, of: type) -> pa.RecordBatch | pa.Table:
        return of.from_arrays([pa.array(list(held), like), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([text_of(x) for _, x in held.values()], pa.string())], [name for name, _ in kinds])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        like = None
        for b in batches:
            like = b.column(0).type
            together(b.column(0).to_pylist(), [1] * b.num_rows, b.column(1).to_pylist(), held)
            if len(held) >= HELD_GROUPS:
                yield table(held, like, pa.RecordBatch)
                held.clear()
        if held:
            yield table(held, like, pa.RecordBatch)

    def whole(rows: pa.Table) -> pa.Table:
        held: dict = {}
        together(rows[by].to_pylist(), rows["parts"].to_pylist(), rows["fingerprint"].to_pylist(), held)
        out = table(held, rows[by].type, pa.Table)
        return out.append_column("n_distinct", pa.array([distinct(x, k) for _, x in held.values()], pa.float64()))

    return sketched.select(by, "fingerprint").mapInArrow(partial, schema).groupBy(by).applyInArrow(whole, f"{schema}, n_distinct double")


def with_edited_neighbour(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document by
    descending doc_id; after the last comes the first. Rows: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_distinct (estimated distinct shingles) and kept_share (estimated share of them that the
    edited text has). Texts are moved once: ids are cut into ranges, every row goes to its
    range, and the first row of each range also to the one before it; a task streams its range in order. Null
    texts count as empty; rows with a null doc_id come last; rows with the same doc_id follow by text, repeated rows each other. Other
    columns are ignored; an empty table gives an empty one, and a single row is its own next.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, kept_share double"
    names = [x.split()[0] for x in schema.split(", ")]
    spark = docs.sparkSession
    doc = F.col("doc_id").cast("long")
    base = docs.select(F.coalesce(doc, F.lit(-(1 << 63))).alias("id"), doc.isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(base.select("id").stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # -1 keeps a bound's own rows together with what is above it; equal ids are never parted
    cuts = F.array(*[F.lit(int(b)).cast("long") for b in bounds]) if bounds else None
    part = F.size(F.filter(cuts, lambda b: b <= F.col("id"))) if cuts is not None else F.lit(0)
    base = base.withColumn("part", part.cast("int"))
    heads = checkpointed(base.groupBy("part").agg(F.max(F.struct("id", (~F.col("none")).alias("real"), F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("top")).select("part", "top.*")).orderBy(F.desc("part")).collect()
    if not heads:
        return spark.createDataFrame([], schema)
    # one row a range: the range whose last row is followed by this range's first
    to = {h["part"]: heads[(i - 1) % len(heads)]["part"] for i, h in enumerate(heads)}
    border = spark.createDataFrame([(h["id"], not h["real"], h["h"], h["n"], to[h["part"]]) for h in heads], "id long, none boolean, _h long, _n int, part int")
    borders = base.drop("part").join(F.broadcast(border), ["id", "none"]).where((F.xxhash64("text") == F.col("_h")) & (F.length("text") == F.col("_n"))).select("id", "text", "part", F.lit(1).alias("border"), "none")
    rows = base.select("id", "text", "part", F.lit(0).alias("border"), "none").union(borders)
    rows = rows.repartition(max(parts, len(heads)), "part").sortWithinPartitions("part", "border", F.desc("id"), "none", F.desc(F.xxhash64("text")), F.desc(F.length("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next isn't known yet

        def flush(pairs: list[tuple]) -> pa.RecordBatch:
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
            sk, nk, ek = [a[5] for a, _ in pairs], [b[5] for _, b in pairs], sketches(pa.array(edited, pa.large_string()), k)
            double = lambda f, x, y: pa.array([f(p, q, k) for p, q in zip(x, y, strict=True)], pa.float64())
            cols = [
                pa.array([None if a[4] else a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([text_of(x) for x in sk], pa.string()),
                pa.array([text_of(x) for x in ek], pa.string()),
                double(resemblance, sk, ek),
                double(resemblance, sk, nk),
                pa.array([distinct(x, k) for x in sk], pa.float64()),
                double(containment, sk, ek),
            ]
            return pa.RecordBatch.from_arrays(cols, names)

        for whole in batches:
            for batch in V.slices(whole):
                pairs = []
                for row in zip(*[c.to_pylist() for c in batch.columns], sketches(batch.column(1), k), strict=True):
                    if held is not None and held[2] == row[2] and not held[3]:
                        if row[3]:
                            if not ended:
                                pairs.append((held, row))
                                ended = True
                            continue
                        pairs.append((held, row))
                    held, ended = row, False
                yield flush(pairs)

    return rows.mapInArrow(V.releasing(run), schema)
