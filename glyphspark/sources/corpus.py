"""Sources and sinks: corpora, gold texts, rules, models and written transcriptions."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphspark.functions.readers import Rule, parsed_rules
from glyphspark.functions.text import remove_common_prefix

FORMATS = ["DIPL", "NORM", "NORMLINES", "COMP", "HTML", "ALTO", "WHITESPACE"]  # fixed values


def read_texts(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """(path, text) of all files below a folder, hidden ones left out, one row a file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def as_stream(text: F.Column) -> F.Column:
    """A file as one stream of characters: its lines that aren't empty, each with a space behind."""
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.concat(x, F.lit(" "))), "")


def take_chars(files: DataFrame, limit: int) -> DataFrame:
    """Files (lang, path, text) whose streams make up the first ``limit`` characters of their language (0 or less: all), by path.

    Reading stops after the line in which the limit is reached, so the last file may be cut there.
    """
    if limit <= 0:
        return files
    w = Window.partitionBy("lang").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # files, not characters
    sized = files.withColumn("_size", F.length(as_stream(F.col("text")))).withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    ends = F.transform(lines, lambda x: F.length(x) + 1)
    room = F.lit(limit) - F.col("_before")
    count = F.aggregate(ends, F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")), lambda a, x: F.when(a["sum"] >= room, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum"))), lambda a: a["n"])
    cut = F.when(F.col("_size") <= room, F.col("text")).otherwise(F.array_join(F.slice(lines, F.lit(1), count), "\n"))
    return sized.where(F.col("_before") < limit).withColumn("text", cut).drop("_size", "_before")


def _base_name(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_images(spark: SparkSession, paths: str | list[str], skip: int = 0, take: int = 0) -> DataFrame:
    """(base_name, path, content) of page images, everything but texts, by name; after ``skip`` of them, ``take`` (0 or less: all)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(~F.col("path").rlike(r"\.txt$"))
    found = files.select(_base_name(F.col("path")).alias("base_name"), "path", "content")
    return skip_take(found, "base_name", skip, take) if skip > 0 or take > 0 else found


def read_levels(spark: SparkSession, paths: str | list[str], grey: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> DataFrame:
    """(base_name, path, width, height, levels): page images as grey levels, column by column, a byte each.

    Images are decoded by Spark's image source, those that it can't decode are left out. Colours count by ``grey`` (red, green, blue).
    """
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(paths).select("image.*")
    schema = "base_name string, path string, width int, height int, levels binary"

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                flat = px[:, :, 0] if r.nChannels == 1 else px[:, :, 2] * grey[0] + px[:, :, 1] * grey[1] + px[:, :, 0] * grey[2]
                out.append((r.base_name, r.origin, r.width, r.height, np.rint(flat).astype(np.uint8).T.tobytes()))
            yield pd.DataFrame(out, columns=["base_name", "path", "width", "height", "levels"])

    return raw.withColumn("base_name", _base_name(F.col("origin"))).mapInPandas(run, schema)


def read_line_images(spark: SparkSession, folder: str) -> DataFrame:
    """(base_name, line_no, width, height, levels) of lines cut out before, in ``<base>-line_extract_<ext>/line<NN>.<ext>``.

    Lines of a document must be numbered from 0 without gaps.
    """
    files = read_levels(spark, folder).where(F.col("path").rlike(r"-line_extract_[^/]*/line[0-9]+\.[^./]*$"))
    rows = files.select(F.regexp_extract("path", r"([^/]+)-line_extract_[^/]*/[^/]*$", 1).alias("base_name"), F.regexp_extract("path", r"line([0-9]+)\.[^./]*$", 1).cast("int").alias("line_no"), "width", "height", "levels")
    return checked_lines(rows, "base_name")


def checked_lines(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Lines (by, line_no, ...); an error if a document's lines aren't numbered from 0 without gaps."""
    bad = lines.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line_no").alias("k"), F.min("line_no").alias("a"), F.max("line_no").alias("b")).where("a <> 0 or b <> n - 1 or k <> n").limit(1).collect()
    if bad:
        raise ValueError(f"lines of {bad[0][by]!r} are missing or there twice")
    return lines


def write_lines_cache(lines: DataFrame, path: str) -> None:
    """Cut lines (doc_id, line_no, width, height, pixels) as a table that later runs read instead of the pages."""
    lines.write.mode("append").parquet(path)


def not_extracted(pages: DataFrame, cache: DataFrame | None, on: str = "doc_id") -> DataFrame:
    """Pages without lines in the table yet."""
    return pages if cache is None else not_done(pages, cache, on)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(base_name, line_no, image_path, text_path, long_s) of a list of documents cut into line images.

    Every line of the list has five fields between white space: the images' path up to the line's number, what follows the
    number, the path of the text, whether it has long s, and the number of lines. Paths are relative to the list's folder.
    """
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    if parts.where(F.size("p") != 5).limit(1).count():
        raise ValueError("a document of the list has five fields")
    get = lambda k: F.get("p", k)
    rows = parts.where(get(4).cast("int") > 0).select("p", F.explode(F.sequence(F.lit(0), get(4).cast("int") - 1)).alias("line_no"))
    prefix = F.concat(F.lit(f"{folder}/"), get(0))
    name = F.regexp_extract(get(0), "([^/]*).$", 1)
    return rows.select(name.alias("base_name"), "line_no", F.concat(prefix, F.col("line_no").cast("string"), get(1)).alias("image_path"), F.concat(F.lit(f"{folder}/"), get(2)).alias("text_path"), (F.lower(get(3)) == "true").alias("long_s"))


def allowed_fonts(fonts: DataFrame, names: DataFrame, on: str = "font") -> DataFrame:
    """Fonts whose name is in a list (``path_list``), all if the list is empty."""
    if not names.limit(1).count():
        return fonts
    return fonts.join(names.select(F.col("path").alias(on)).distinct(), on, "left_semi")


def skip_take(docs: DataFrame, by: str, skip: int, take: int) -> DataFrame:
    """Documents in order, after the first ``skip``, ``take`` of them (0 or less: all)."""
    out = docs.orderBy(by).offset(skip)
    return out.limit(take) if take > 0 else out


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a file with a path on each line."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("path"))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Replacement rules of a file of some dozens of lines (``parsed_rules``)."""
    return parsed_rules("\n".join(r["value"] for r in spark.read.text(path).collect()))


def parse_languages(spec: str) -> dict[str, str]:
    """``lang->value,lang->value`` as a dictionary."""
    out = {}
    for part in filter(None, spec.split(",")):
        lang, arrow, value = part.partition("->")
        if not arrow:
            raise ValueError(f"not lang->value: {part!r}")
        out[lang.strip()] = value.strip()
    return out


@dataclass(frozen=True)
class LanguageModelOptions:
    """Options of language model training, with their usual values; all dictionaries have the same languages."""

    texts: dict[str, str]
    priors: dict[str, float] = field(default_factory=dict)
    orders: dict[str, int] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    min_char_count: int = 10
    keep_language: float = 0.999999
    insert_long_s: bool = False
    remove_diacritics: bool = False
    explicit_chars: str | None = None
    escapes: bool = False
    order: int = 6
    lm_power: float = 4.0
    lm_char_count: int = 0

    def __post_init__(self) -> None:
        for other in (self.priors, self.orders, self.rules):
            if other and set(other) != set(self.texts):
                raise ValueError("the languages of the options differ")
        if not self.texts:
            raise ValueError("no texts")


def parse_formats(names: str, glyph_substitution: bool) -> set[str]:
    """Output formats by name; normalised ones need glyph substitution; the default is diplomatic, and normalised if it can be."""
    chosen = {x.strip() for x in names.split(",") if x.strip()}
    if unknown := chosen - set(FORMATS):
        raise ValueError(f"unknown output formats: {sorted(unknown)}")
    if not chosen:
        return {"DIPL", "NORM"} if glyph_substitution else {"DIPL"}
    if not glyph_substitution and chosen & {"NORM", "NORMLINES"}:
        raise ValueError("normalised output needs glyph substitution")
    return chosen


def pair_gold(docs: DataFrame, gold: DataFrame, on: str = "doc_id") -> DataFrame:
    """Documents with their gold text, null where there is none."""
    return docs.join(gold, on, "left")


def read_gold(spark: SparkSession, path: str, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold lines (doc_id, line_no, text) of the documents ``docs`` (doc_id, base_name): diplomatic from ``<base>.txt``, normalized from ``<base>_normalized.txt``.

    ``base`` is the file name without its ending; files are looked for in ``path`` and below. Documents without a file have no rows; it is
    an error if none has any.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    files = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("_name"), F.regexp_replace("value", r"\n$", "").alias("_text"))
    base = docs.select("doc_id", F.regexp_replace(F.regexp_extract("base_name", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("_base")).distinct()
    made = [base.join(files, F.concat("_base", F.lit(end)) == F.col("_name")).select("doc_id", F.posexplode(F.split("_text", "\n", -1)).alias("line_no", "text")) for end in ("", "_normalized")]
    if not any(df.limit(1).count() for df in made):
        raise ValueError("no document has a gold transcription")
    return made[0], made[1]


def not_done(docs: DataFrame, done: DataFrame, on: str = "doc_id", fail_if_none: bool = False) -> DataFrame:
    """Documents without a transcription yet; optionally an error if none are left."""
    left = docs.join(done.select(on).distinct(), on, "left_anti")
    if fail_if_none and left.limit(1).count() == 0:
        raise ValueError("all documents have been transcribed")
    return left


def batch_of(number: F.Column, total: F.Column, size: int) -> F.Column:
    """Mini-batch of the number-th of ``total`` documents: full batches of ``size``, a remainder joins the last."""
    return F.least(F.ceil(number / size), F.greatest(F.lit(1), F.floor(total / size)))


def gold_running(lines: DataFrame) -> DataFrame:
    """(doc_id, text): gold lines as one text, spaces collapsed."""
    from glyphspark.operators.transcript import in_order

    return lines.groupBy("doc_id").agg(F.trim(F.regexp_replace(in_order(F.concat(F.col("text"), F.lit(" ")), "line_no"), " +", " ")).alias("text"))


def output_name(doc: F.Column, iteration: int = 0, batch: int = 0) -> F.Column:
    tail = (f"_iter-{iteration}" if iteration > 0 else "") + (f"_batch-{batch}" if batch > 0 else "")
    return F.concat(F.lit("all_transcriptions/"), doc.cast("string"), F.lit(tail))


def output_path(path: str, inputs: str, output: str, iteration: int = 0, batch: int = 0) -> str:
    """Where the transcription of the page at ``path`` goes: folders as below ``inputs``, the name without extension, then round and batch."""
    parent = remove_common_prefix(os.path.dirname(os.path.abspath(inputs)), os.path.dirname(os.path.abspath(path)))[1]
    name = os.path.basename(path)
    name = name[: name.rindex(".")] if "." in name else name
    return f"{output}/all_transcriptions/{parent}/{name}" + (f"_iter-{iteration}" if iteration > 0 else "") + (f"_batch-{batch}" if batch > 0 else "")


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model as Parquet tables, one folder each, by language where a table has one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("lang") if "lang" in df.columns else writer).parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_lines(lines: DataFrame, path: str) -> None:
    """Transcriptions as text files, a folder for each document, lines in order."""
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(path)


def gsm_report(counts: DataFrame, probs: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(language, lmChar, glyph, count, minProb, prob): glyphs counted more often than smoothing does, and those of a few usual characters."""
    usual = [" ", "-", "a", "b", "c", "d", "ſ"]
    least = probs.groupBy("lang", "lm_char").agg(F.min("p").alias("least"))
    rows = probs.join(counts.select("lang", "lm_char", "glyph", "c"), ["lang", "lm_char", "glyph"], "left").join(least, ["lang", "lm_char"])
    count = F.coalesce("c", F.lit(0.0))
    shown = (count > smoothing) | (F.col("lm_char").isin(usual) & (F.col("glyph").isin(usual) | (F.length("glyph") > 1)))
    return rows.where(shown).select(F.col("lang").alias("language"), F.col("lm_char").alias("lmChar"), "glyph", count.alias("count"), F.col("least").alias("minProb"), F.col("p").alias("prob"))


def write_gsm(counts: DataFrame, probs: DataFrame, path: str, smoothing: float = 1.0) -> None:
    """``gsm_report`` as text with tabs."""
    gsm_report(counts, probs, smoothing).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
