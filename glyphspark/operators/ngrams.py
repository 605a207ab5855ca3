"""Character n-gram counts and the types that smoothing needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters that are counted at once, some 100 bytes of memory each.
CHUNK = 1 << 20


def lines_of(docs: DataFrame, most: int = 0) -> DataFrame:
    """(doc_id, lang, line_no, line) of all lines that aren't empty; of the first ``most`` lines of a text, if that is positive."""
    lines = F.split("text", "\n", -1)
    lines = F.slice(lines, F.lit(1), F.lit(most)) if most > 0 else lines
    return docs.select("doc_id", "lang", F.posexplode(lines).alias("line_no", "line")).where("line <> ''")


def grams(lines: DataFrame, order: int, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, g): for every character the n-gram of full length (shorter at a line's start) that ends there.

    Each length is zipped from the one below, in a column of its own, so that nothing is evaluated twice.
    """
    df = lines.select(*keys, F.split("line", "").alias("_1"))
    for n in range(2, order + 1):
        tail = F.slice("_1", F.lit(n), F.greatest(F.size("_1") - n + 1, F.lit(0)))
        df = df.withColumn("_tail", tail).withColumn(f"_{n}", F.zip_with(F.slice(f"_{n - 1}", F.lit(1), F.size("_tail")), F.col("_tail"), lambda a, b: F.concat(a, b)))
    ends = F.concat(*[F.slice(f"_{n}", F.lit(1), F.lit(1)) for n in range(1, order)], F.col(f"_{order}"))
    return df.select(*keys, F.explode(ends).alias("g"))


def _counted(lines: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct ``grams`` of lines, and how often each is there."""
    text = "".join(lines)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    starts = np.cumsum([0, *map(len, lines[:-1])])
    place = np.arange(codes.size) - np.repeat(starts, [len(x) for x in lines])
    keys = codes
    for n in range(1, order):  # three characters fit a key; before each one more, keys are numbered anew
        if n > 2:
            keys = np.unique(keys, return_inverse=True)[1].reshape(-1) + 1
        before = np.zeros_like(codes)
        before[n:] = np.where(place[n:] >= n, codes[:-n], 0)
        keys = keys | before << (21 * n if n < 3 else 42)
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    size = np.minimum(place[first] + 1, order)
    return [text[i + 1 - k : i + 1] for i, k in zip(first.tolist(), size.tolist(), strict=True)], counts


def counted_in_parts(lines: DataFrame, order: int, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, g, t): how often each of the ``grams`` is there, in parts that stand for themselves: an n-gram may have several rows."""
    rows = lines.select(*keys, "line")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("g", T.StringType()), T.StructField("t", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))], strict=True)) if keys else [()] * batch.num_rows
            groups: dict[tuple, list[str]] = {}
            at = 0
            for k, (key, line) in enumerate(zip(own, batch.column(len(keys)).to_pylist(), strict=True), 1):
                if line:
                    groups.setdefault(key, []).append(line)
                    at += len(line)
                if groups and (at >= CHUNK or k == batch.num_rows):
                    found = [(key, *_counted(x, order)) for key, x in groups.items()]
                    sizes = [len(g) for _, g, _ in found]
                    columns = [pa.array([key[i] for key, _, _ in found], arrow.field(i).type).take(np.repeat(np.arange(len(found)), sizes)) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([x for _, g, _ in found for x in g], arrow.field("g").type), pa.array(np.concatenate([t for _, _, t in found]), pa.int64())], schema=arrow)
                    groups, at = {}, 0

    return rows.mapInArrow(run, schema)


def contexts(lines: DataFrame, order: int, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, g, t): how often each of the ``grams`` is there."""
    return counted_in_parts(lines, order, keys).groupBy(*keys, "g").agg(F.sum("t").alias("t"))


def token_counts(lines: DataFrame, order: int = 3, keys: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(lang, g, n, t): occurrences of every n-gram up to ``order``; n-grams don't cross lines.

    One n-gram for each character is counted; the shorter ones are ends of those, added up from the distinct ones.
    """
    longest = contexts(lines, order, keys)
    ends = F.transform(F.sequence(F.lit(1), F.length("g")), lambda n: F.right("g", n))
    return longest.select(*keys, F.explode(ends).alias("g"), "t").groupBy(*keys, "g").agg(F.sum("t").alias("t")).withColumn("n", F.length("g"))


def history_types(tok: DataFrame) -> DataFrame:
    """(lang, h, hist): distinct continuations of a history."""
    return tok.where("n > 1").groupBy("lang", F.expr("substring(g, 1, n - 1)").alias("h")).agg(F.count(F.lit(1)).alias("hist"))


def lower_types(tok: DataFrame) -> DataFrame:
    """(lang, g, low): distinct characters before an n-gram."""
    return tok.where("n > 1").groupBy("lang", F.expr("substring(g, 2, n - 1)").alias("g")).agg(F.count(F.lit(1)).alias("low"))


def lower_normalizers(tok: DataFrame) -> DataFrame:
    """(lang, m, norm): distinct pairs of characters around an n-gram (the empty one: all bigram types)."""
    return tok.where("n > 1").groupBy("lang", F.expr("substring(g, 2, n - 2)").alias("m")).agg(F.count(F.lit(1)).alias("norm"))


def char_counts(lines: DataFrame) -> DataFrame:
    return token_counts(lines, 1).select("lang", F.col("g").alias("char"), F.col("t").alias("n"))


def active_chars(counts: DataFrame, min_count: int = 10) -> DataFrame:
    """(lang, char): characters seen often enough, and those that every language has."""
    from glyphspark.functions.charset import UNIVERSAL_PUNCTUATION

    always = counts.select("lang").distinct().select("lang", F.explode(F.array(*[F.lit(c) for c in [" ", *UNIVERSAL_PUNCTUATION]])).alias("char"))
    return counts.where(F.col("n") >= min_count).select("lang", "char").union(always).distinct()


def indexed_chars(active: DataFrame) -> DataFrame:
    """(char): everything a font needs a template for: active characters, long s, ligatures and their parts, base letters, forms with a tilde.

    ``active`` is as small as alphabets; what is added belongs to no language.
    """
    from glyphspark.functions import charset

    chars = {r["char"] for r in active.select("char").distinct().collect()} | {"ſ", *charset.LIGATURES}
    chars |= {c for pair in charset.LIGATURES.values() for c in pair}
    for c in list(chars):
        try:
            base = charset.base_of(c)
        except charset.CharError:  # stands for itself
            continue
        chars |= {base} | {form for form in (charset.tilde_form(c), charset.tilde_form(base)) if form}
    return active.sparkSession.createDataFrame([(c,) for c in sorted(chars)], "char string")
