"""Model versions that are there whole or not at all, and the laid out mini-batches that training reads.

A version's folder has tables for the font and the glyph substitution, and the language models' stores, which never change once
written; the manifest that names them is written last, by a rename. What has no manifest doesn't count, so a run that was
killed goes on behind the last whole version.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.operators import lm
from glyphspark.operators.decoder import GlyphModel
from glyphspark.operators.lm_store import StoredStats, attached
from glyphspark.operators.shared import checkpointed

MANIFEST = "models.json"


def _file(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, what: dict[str, Any]) -> None:
    """Write ``what`` as JSON so that ``path`` has all of it or isn't there."""
    own = f"{path}.{uuid.uuid4().hex}"
    file, fs = _file(spark, own)
    out = fs.create(file, True)
    out.write(bytearray(json.dumps(what, ensure_ascii=False).encode()))
    out.close()
    target, _ = _file(spark, path)
    fs.delete(target, False)
    if not fs.rename(file, target):
        raise OSError(f"{path} can't be written")


def committed(spark: SparkSession, path: str) -> dict[str, Any] | None:
    file, fs = _file(spark, path)
    if not fs.exists(file):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))  # one file of settings


def _parts(model: lm.Backoff | lm.Mixture) -> list[tuple[lm.Backoff, float]]:
    return model.parts if isinstance(model, lm.Mixture) else [(model, 1.0)]


def save(spark: SparkSession, models: Any, path: str, font_path: str | None = None) -> None:
    """Commit all models as the version at ``path``. Language models must be over stores (``lm.models_of``)."""
    from glyphspark.operators.training import font_frame

    font_path = font_path or f"{path}/font"
    font_frame(spark, models.font).write.mode("overwrite").parquet(font_path)
    glyphs = None
    if models.glyphs is not None:
        rows = [(*k, p) for k, p in models.glyphs.probs.items()]
        spark.createDataFrame(rows, "lang string, lm_char string, glyph string, p double").coalesce(1).write.mode("overwrite").parquet(f"{path}/glyphs")
        glyphs = {"active": models.glyphs.active, "elide_anything": models.glyphs.elide_anything, "no_sub": models.glyphs.no_sub, "power": models.glyphs.power}
    languages = {}
    for lang, model in models.languages.items():
        own = _parts(model)
        if not all(isinstance(m.stats, StoredStats) for m, _ in own):
            raise ValueError(f"the model of {lang} isn't in a store")
        languages[lang] = [{"files": m.stats.files, "order": m.order, "power": m.power, "weight": w} for m, w in own]
    offsets = None if models.offsets is None else [models.offsets.start, models.offsets.stop, models.offsets.step]
    commit(spark, f"{path}/{MANIFEST}", {"font": font_path, "languages": languages, "mixed": [x for x, m in models.languages.items() if isinstance(m, lm.Mixture)], "priors": models.priors, "chars": models.chars, "keep": models.keep, "order": models.order, "glyphs": glyphs, "switch_on_punctuation": models.switch_on_punctuation, "offsets": offsets})


def exists(spark: SparkSession, path: str) -> bool:
    return committed(spark, f"{path}/{MANIFEST}") is not None


def load(spark: SparkSession, path: str) -> Any:
    """The models of the version at ``path``."""
    from glyphspark.operators.training import Models, font_of

    has = committed(spark, f"{path}/{MANIFEST}")
    if has is None:
        raise FileNotFoundError(f"{path} has no whole version")
    languages: dict[str, Any] = {}
    for lang, parts in has["languages"].items():
        own = [(lm.Backoff(attached(spark, lang, p["files"]), p["order"], p["power"]), p["weight"]) for p in parts]
        languages[lang] = lm.Mixture(own) if lang in has["mixed"] else own[0][0]
    glyphs = None
    if has["glyphs"] is not None:
        probs = {(r["lang"], r["lm_char"], r["glyph"]): r["p"] for r in spark.read.parquet(f"{path}/glyphs").collect()}  # as small as alphabets
        more = dict(has["glyphs"])
        glyphs = GlyphModel(probs, more.pop("active"), **more)
    offsets = None if has["offsets"] is None else range(*has["offsets"])
    return Models(font_of(spark.read.parquet(has["font"])), languages, has["priors"], has["chars"], has["keep"], has["order"], glyphs, has["switch_on_punctuation"], offsets)


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """(column, number): distinct values numbered from 1 in order, by ranges: only the ranges' counts come together."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ids.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    placed = checkpointed(placed.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    before, starts = 0, []
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_part").collect():  # a row a range
        starts.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    if not starts:
        return placed.select(column, F.col("_at").alias("number"))
    start = ids.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(start), "_part").select(column, (F.col("_at") + F.col("_start")).alias("number"))  # a row a range


def laid_out(lines: DataFrame, path: str, size: int) -> tuple[DataFrame, int]:
    """``lines`` with their mini-batch (``batch_no``) of ``size`` documents, and the number of batches; a remainder joins the last batch.

    With more than one batch the lines are written once below ``path``, a folder for each batch, and read by folder. A layout that is
    there already is used again if it is of the same lines, else it is an error.
    """
    spark = lines.sparkSession
    # what the lines are: their places, whatever order they come in
    place = F.xxhash64("doc_id", "line_no").cast("decimal(38,0)")
    about = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("docs"), F.sum(place).alias("places")).first()
    same = {"lines": about["lines"], "docs": about["docs"], "places": str(about["places"]), "size": size}
    batches = max(1, about["docs"] // size) if size > 0 else 1
    known = committed(spark, f"{path}/lines.json")
    if known not in (None, same):
        raise ValueError(f"{path} has a training of other lines")
    if batches == 1:
        if known is None:
            commit(spark, f"{path}/lines.json", same)
        return lines.withColumn("batch_no", F.lit(1)), 1
    if known is None:
        number = F.least(F.ceil(F.col("number") / size), F.lit(batches)).cast("int").alias("batch_no")
        rows = lines.join(numbered(lines, "doc_id").select("doc_id", number), "doc_id")
        rows.write.mode("overwrite").partitionBy("batch_no").parquet(f"{path}/lines")
        commit(spark, f"{path}/lines.json", same)
    return spark.read.parquet(f"{path}/lines"), batches
