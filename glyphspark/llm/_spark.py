"""Spark helpers shared by the text operators: lineage cuts, size-checked joins, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only after its bytes were counted (strings, arrays and all) and are no more than this.
BROADCAST_BYTES = 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary one; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="glyphspark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(of: Column, kind: T.DataType) -> Column:
    """Bytes of a value, with 16 for what surrounds it."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(of).cast("long")
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            size = F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
        else:
            size = 8 * F.size(of).cast("long")
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [_bytes(of[f.name], f.dataType) for f in kind.fields])
    else:
        size = F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0).cast("long")) + 16


def join_counted(df: DataFrame, side: DataFrame, on: list[str] | str | Column, how: str) -> DataFrame:
    """Join with ``side``, broadcast if a count of its bytes proves it small, else by a shuffle (adaptive execution splits hot keys)."""
    side = checkpointed(side)
    size = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in side.schema.fields])
    small = (side.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(side) if small else side.hint("shuffle_merge"), on, how)


#: What an Arrow batch of whole texts holds at most: rows, and bytes (but for a longer single text).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of whole texts are held by the JVM and the worker at once: fewer rows than by default, and bounded bytes.

    A setting that the session has already made smaller stays.
    """
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        old = spark.conf.get(name).lower().rstrip("b")
        if old.isdigit() or old.startswith("-"):  # a value with a unit is the caller's own
            if int(old) <= 0 or int(old) > value:
                spark.conf.set(name, str(value))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside lambdas, what isn't a variable is computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def text_hash(text: Column) -> list[Column]:
    """A 128-bit hash of a text as two columns, of equal values for equal texts (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of undirected ``edges`` (u, v long): rows (node, component).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two aggregates by node with
    partial sums and two joins, cut by a checkpoint; the edges at most stay as many, and the rounds grow with the
    logarithm of the longest path. Nodes without edges are not returned.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
