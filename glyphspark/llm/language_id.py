"""Op 2: language identification by compression against per-language dictionaries.

``fit`` draws a bounded sample of whole labelled texts for each language, by a hash of id and text, and keeps as many of
them as fit into ``dict_bytes`` as a zstandard raw-content dictionary. ``predict`` compresses every whole text with each
dictionary; the language that needs the fewest bytes wins, and a text whose two best languages lie within
``min_margin`` of each other (relative to the second) is rejected. What is compressed is the text's distinct words in
lower case, in order: upper-case text then meets the dictionaries, and repeats, which any dictionary shortens alike,
don't drown the difference. Prediction has no shuffle; the dictionaries
(languages times ``dict_bytes``) are the only thing sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphspark.llm import _vec as V

UNKNOWN = "und"
#: The classifier is fitted on a sample: whole texts of a language at most (about), their bytes at most, bytes of a dictionary
#: at most. More languages than ``MAX_LANGUAGES`` are an error.
SAMPLE_TEXTS, SAMPLE_BYTES, DICT_BYTES, MAX_LANGUAGES = 800, 800_000, 400_000, 500
LEVEL = 3
#: A relative margin under this is narrow.
MIN_MARGIN = 0.002
_WORD = re.compile(r"[^\W\d_]+")


def reduced(text: str) -> str:
    """Distinct words of a text in lower case, by first occurrence. Words are runs of letters; other numerals than digits are no letters."""
    words = dict.fromkeys(_WORD.findall(text.lower()))
    if text.isascii():
        return " ".join(words)
    return " ".join(dict.fromkeys(x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())))


def fit(train: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from ``train`` (doc_id, text, lang). Rows with a null or letterless text or a null language are left out.

    Of each language about ``sample_texts`` rows are drawn by hash, repeated rows once and none of more than ``sample_bytes``; of
    these, in the hash's order, whole texts until ``sample_bytes`` are full. The dictionary takes whole texts too, and passes
    over one that its ``dict_bytes`` have no room for. Empty training rows give no dictionary; then every prediction is ``und``. More than
    ``MAX_LANGUAGES`` languages are an error.
    """
    train = train.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang")).where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    sizes = train.groupBy("_lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["_lang"]), F.lit(sample_texts / r["count"]))])
    place = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 40))
    fits = F.octet_length("_text") <= sample_bytes
    drawn = train.where((place / F.lit(float(1 << 40)) < F.element_at(share, F.col("_lang"))) & fits).select("_lang", place.alias("_place"), "_text")
    drawn = drawn.groupBy("_lang", "_place").agg(F.max("_text").alias("_text"))  # repeated rows have one place
    so_far = Window.partitionBy("_lang").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = drawn.withColumn("_sum", F.sum(F.octet_length("_text").cast("long")).over(so_far)).where(F.col("_sum") <= sample_bytes)
    texts: dict[str, list[bytes]] = {}
    left = dict.fromkeys([r["_lang"] for r in sizes], dict_bytes)
    for r in taken.orderBy("_lang", "_place").toLocalIterator():  # sample_bytes for each language at most
        body = reduced(r["_text"]).encode()
        if len(body) < left[r["_lang"]]:
            texts.setdefault(r["_lang"], []).append(body)
            left[r["_lang"]] -= len(body) + 1
    return {lang: b"\n".join(own) for lang, own in sorted(texts.items())}


def _prediction(sizes: list[int], langs: list[str], min_margin: float) -> tuple[str, float, bool]:
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], langs[k]))
    best, second = sizes[order[0]], sizes[order[1]] if len(sizes) > 1 else 2 * sizes[order[0]]
    margin = (second - best) / second
    return langs[order[0]], 1 / (1 + math.exp(-200 * margin)), margin < min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text of ``docs`` (doc_id, text).

    Rows: the columns ``keep`` (doc_id; those named like the new ones are replaced), lang_pred, score (a logistic of the margin, 0
    to 1), rejected. A null text or one without letters is ``und`` with score 0 and rejected; ties go to the language first
    by name and are rejected. Rows repeat as the input's do; an empty table gives an empty one.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("lang_pred", "score", "rejected")]
    source = docs.select(*keep, F.col("text").alias("_gs_text"))
    schema = source.drop("_gs_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(dictionaries)
        coders = []
        for lang in langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False).compress)
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1):
                body = reduced(text.as_py() or "").encode()
                if not body or not coders:
                    rows.append((UNKNOWN, 0.0, True))
                else:
                    rows.append(_prediction([len(f(body)) for f in coders], langs, min_margin))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + made, batch.schema.names[:-1] + ["lang_pred", "score", "rejected"])

    return source.mapInArrow(V.releasing(run), schema)
