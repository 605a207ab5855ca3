"""Transcribing as pages arrive: each micro-batch is decoded, and models are counted on, as versioned tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphspark.operators import versions
from glyphspark.operators.decoder import decode
from glyphspark.operators.ngrams import grams, lines_of
from glyphspark.operators.training import Models, Updates, m_step
from glyphspark.operators.versions import _file


def transcribe_stream(source: DataFrame, path: str, checkpoint: str, transcribe: Callable[[DataFrame], DataFrame], update: Callable[[SparkSession, int], None] | None = None) -> StreamingQuery:
    """Decode every micro-batch of ``source`` into ``path/batch=<n>``; then ``update`` may refit models for the batches that follow.

    A batch that is run again after a failure overwrites its own folder, so results stay exactly once.
    """

    def step(batch: DataFrame, number: int) -> None:
        transcribe(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if update is not None:
            update(batch.sparkSession, number)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Micro-batches whose changed counts are kept apart before they are put together.
COMPACT_EVERY = 10


def ngram_stream(source: DataFrame, path: str, checkpoint: str, order: int = 3, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Running n-gram counts of arriving documents (doc_id, text, lang), by keyed state: ``counts_so_far`` gives them.

    The state store holds a total for each n-gram; a micro-batch writes the totals that it changed, with its number, to a folder of
    its own, which it overwrites if it runs again. Every ``compact_every`` batches the last totals become one table, and
    what it covers goes with the next one. Nothing that arrived before is read again.
    """
    every = grams(lines_of(source), order, ("lang",))
    ends = every.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.length("g")), lambda n: F.right("g", n))).alias("g"))
    counts = ends.groupBy("lang", "g").agg(F.count(F.lit(1)).alias("t")).withColumn("n", F.length("g"))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("seen", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/changed/{number}")
        if (number + 1) % compact_every == 0:
            _latest(spark, *_tables(spark, path, number)).write.mode("overwrite").parquet(f"{path}/whole/{number}")
            for kind, old in _numbers(spark, path):
                if old < number - compact_every and not (kind == "whole" and old == number):
                    folder, fs = _file(spark, f"{path}/{kind}/{old}")
                    fs.delete(folder, True)

    return counts.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """What was written whole: (changed or whole, number)."""
    out = []
    for kind in ("changed", "whole"):
        folder, fs = _file(spark, f"{path}/{kind}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            done, _ = _file(spark, f"{path}/{kind}/{s.getPath().getName()}/_SUCCESS")
            if fs.exists(done):
                out.append((kind, int(s.getPath().getName())))
    return out


def _tables(spark: SparkSession, path: str, until: int) -> list[str]:
    """The last table of all totals up to a batch, and the changes since."""
    found = [(kind, k) for kind, k in _numbers(spark, path) if k <= until]
    base = max((k for kind, k in found if kind == "whole" and k < until), default=-1)
    return [f"{path}/whole/{base}"] * (base >= 0) + [f"{path}/changed/{k}" for kind, k in sorted(found) if kind == "changed" and k > base]


def _latest(spark: SparkSession, *tables: str) -> DataFrame:
    rows = spark.read.parquet(*tables)
    last = rows.groupBy("lang", "g", "n").agg(F.max_by("t", "seen").alias("t"), F.max("seen").alias("seen"))
    return last.select("lang", "g", "n", "t", "seen")


def counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(lang, g, n, t) after all micro-batches of ``ngram_stream``."""
    found = _numbers(spark, path)
    return _latest(spark, *_tables(spark, path, max(k for _, k in found) + 1)).drop("seen")


def reading_stream(source: DataFrame, models: Models, path: str, checkpoint: str, updates: Updates, **options: Any) -> StreamingQuery:
    """Read lines (doc_id, line_no, width, height, pixels) as they arrive; after each micro-batch the models are re-estimated from it.

    Decode tables and versions of all models are written below ``path`` by batch. A batch begins with the version of the batch before,
    so a stream that is started again, or a batch that is run again, goes on with the same models.
    """
    spark = source.sparkSession
    version = lambda number: f"{path}/models/batch={number}"

    def step(batch: DataFrame, number: int) -> None:
        now = versions.load(spark, version(number - 1)) if number > 0 else models
        place = f"{path}/decode/batch={number}"
        decode(batch, now.font, now.transitions(), **options).write.mode("overwrite").parquet(place)
        versions.save(spark, m_step(now, spark.read.parquet(place), batch, updates, f"{version(number)}/languages"), version(number), f"{path}/font/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
