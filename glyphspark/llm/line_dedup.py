"""Op 8: line deduplication by line-key hashes, giving per-document keep bitmaps. DataFrame functions only.

1. Every text is split into lines; a line's key (stripped, A-Z lower-cased) is hashed to 96 bits. Only hashes go on; they are
   written to the shared folder once, as they are needed twice.
2. Each document's distinct hashes, with the first position of each, are pre-aggregated under a salt by document, so
   that a hash that most documents hold reaches no task as more than a few rows.
3. These rows are range-partitioned by hash and sorted inside by hash, document and position. A window streams over the
   sorted rows: the running number of documents, and the first occurrence. The row at which a hash reaches the wanted number is
   the only one that goes on; nothing is gathered for a hash.
4. Common hashes go back to the hashed lines by a join (adaptive execution splits hot hashes); what is dropped becomes, for
   each document, a run-length bitmap: the first line and the end of every dropped run, ascending.
Texts are moved once at most, to meet their bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphspark.llm._spark import checkpointed

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def line_keys(text: Column) -> Column:
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda x: F.trim(x, F.lit(SPACE)))


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc, version, pos, h1, h2) of every line with a key of one code point at least. ``version`` tells apart texts of one doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(line_keys(text)).alias("pos", "key"))
    return keys.where(F.col("key") != "").select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, place) of every hash of ``lines`` that at least ``min_docs`` documents hold, with its first place (document, position)."""
    own = lines.groupBy("doc", "version", "h1", "h2").agg(F.min("pos").alias("pos"))
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version", "pos")
    partial = own.groupBy("h1", "h2", F.pmod(F.xxhash64("doc", "version"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = partial.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "place")
    so_far = Window.partitionBy("h1", "h2").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = ranged.select("h1", "h2", "n", F.sum("n").over(so_far).alias("n_docs"), F.first("place").over(so_far).alias("place"))
    return streamed.where((F.col("n_docs") >= min_docs) & (F.col("n_docs") - F.col("n") < min_docs)).select("h1", "h2", "place")


def keep_bitmaps(docs: DataFrame, min_docs: int, keep_first: bool = False) -> DataFrame:
    """Documents that lose lines: (doc, version, bitmap array<int>, n_dropped).

    Lines go whose key is in ``min_docs`` documents at least: all of them, or with ``keep_first`` all but the first by
    (doc_id, position). The bitmap holds the first line and the end (exclusive) of every dropped run, ascending.
    """
    lines = checkpointed(_hashed(docs))
    hit = lines.join(common_lines(lines, min_docs), ["h1", "h2"])
    if keep_first:
        same = F.col("doc").eqNullSafe(F.col("place.doc")) & (F.col("version") == F.col("place.version")) & (F.col("pos") == F.col("place.pos"))
        hit = hit.where(~same)
    by = hit.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    first = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    bitmap = F.flatten(F.zip_with(first, last, lambda a, b: F.array(a, b + 1)))
    return by.select("doc", "version", bitmap.alias("bitmap"), F.size("at").cast("long").alias("n_dropped"))


def apply_bitmap(lines: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps: what stands between its dropped runs."""

    def between(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(bitmap, 2 * i - 1))
        return F.slice(lines, start + 1, F.coalesce(F.get(bitmap, 2 * i), F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(bitmap) / 2).cast("int")), between))


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and kept_text added; columns of these names are replaced, all others stay.

    A null or empty text is one empty line, which has no key and is never dropped; a text that loses all lines becomes empty. Rows
    with the same doc_id and text are one document (both lose the same lines); with different texts they are two. A null doc_id
    sorts last. An empty table gives an empty one.
    """
    bitmaps = keep_bitmaps(docs, min_docs, keep_first).withColumnsRenamed({"doc": "_gs_doc", "version": "_gs_version", "bitmap": "_gs_bitmap", "n_dropped": "_gs_dropped"})
    text = F.coalesce(F.col("text"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_gs_doc")) & (F.xxhash64(text) == F.col("_gs_version"))
    lines = F.split(text, "\n", -1)
    out = docs.join(bitmaps, on, "left")
    kept = F.when(F.col("_gs_bitmap").isNull(), text).otherwise(F.array_join(apply_bitmap(lines, F.col("_gs_bitmap")), "\n"))
    made = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("_gs_dropped", F.lit(0).cast("long")), "kept_text": kept}
    return out.withColumns(made).drop("_gs_doc", "_gs_version", "_gs_bitmap", "_gs_dropped")
