"""Language models as immutable sorted stores: no n-gram goes through the driver, and no task holds a table of its own.

A store has the rows of ``lm.lookup`` in shards, sorted by language and by the hash of the string. The driver knows the shards' names
alone. Each machine gets the shards of a language as files of the job, lays them out once as one packed array, and all its tasks
map that into memory; a lookup is a binary search over keys. Strings are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import uuid
from hashlib import sha256

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.operators.shared import new_folder

STATS = ("t", "low", "hist", "norm")
#: Lookups that a task remembers.
REMEMBERED = 200_000


def key_of(text: str) -> int:
    """The hash that Spark's xxhash64 gives a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


class StoredStats:
    """The statistics of one language's strings, read as a dictionary is: (t, low, hist, norm) of a string."""

    def __init__(self, lang: str | None, files: list[str]):
        self.lang, self.files = lang, sorted(files)
        self._rows: np.ndarray | None = None
        self._known: dict[str, tuple[int, ...] | None] = {}

    def __getstate__(self):
        return {"lang": self.lang, "files": self.files}

    def __setstate__(self, state):
        self.__init__(state["lang"], state["files"])

    def rows(self) -> np.ndarray:
        """Keys, then the four counts, a column for each string, keys ascending; laid out by the first task of a machine that asks."""
        if self._rows is None:
            names = [os.path.basename(f) for f in self.files]
            place = os.path.join(SparkFiles.getRootDirectory(), f"store-{sha256('|'.join([repr(self.lang), *names]).encode()).hexdigest()[:24]}.npy")
            if not os.path.exists(place):
                wanted = pc.field("lang").is_null() if self.lang is None else pc.field("lang") == self.lang
                shards = [pq.ParquetFile(SparkFiles.get(n)).read().filter(wanted) for n in names]
                shards = sorted((s for s in shards if s.num_rows), key=lambda s: s["key"][0].as_py())
                rows = np.concatenate([np.stack([s[c].to_numpy() for c in ("key", *STATS)]) for s in shards], axis=1) if shards else np.zeros((5, 0), np.int64)
                if np.any(rows[0, 1:] < rows[0, :-1]):
                    rows = rows[:, np.argsort(rows[0], kind="stable")]
                own = f"{place}.{uuid.uuid4().hex}"
                with open(own, "wb") as out:
                    np.save(out, rows)
                os.replace(own, place)  # whole or not there: tasks of one machine may race
            self._rows = np.load(place, mmap_mode="r")
        return self._rows

    def get(self, text: str, default=None):
        if text in self._known:
            found = self._known[text]
        else:
            rows, key = self.rows(), key_of(text)
            at = int(np.searchsorted(rows[0], key))
            found = tuple(int(x) for x in rows[1:, at]) if at < rows.shape[1] and rows[0, at] == key else None
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[text] = found
        return default if found is None else found

    def __getitem__(self, text: str):
        found = self.get(text)
        if found is None:
            raise KeyError(text)
        return found

    def __contains__(self, text: str) -> bool:
        return self.get(text) is not None

    def __len__(self) -> int:
        return self.rows().shape[1]


def write_store(stats: DataFrame, path: str) -> None:
    """Write ``stats`` (lang, s, t, low, hist, norm), as ``lm.lookup`` makes them: one shuffle, by ranges of language and key."""
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stats.select("lang", F.xxhash64("s").alias("key"), *STATS)
    rows.repartitionByRange(parts, "lang", "key").sortWithinPartitions("lang", "key").write.mode("overwrite").parquet(path)


def open_store(spark: SparkSession, path: str) -> dict[str, StoredStats]:
    """A store's languages. The driver lists shards and hands them to the job's files; it reads none."""
    shards = spark.read.parquet(path).select("lang", F.col("_metadata.file_path").alias("file")).distinct().collect()
    files: dict[str, list[str]] = {}
    for r in shards:
        files.setdefault(r["lang"], []).append(r["file"])
    return {lang: attached(spark, lang, own) for lang, own in sorted(files.items(), key=lambda x: (x[0] is None, x[0]))}


def attached(spark: SparkSession, lang: str | None, files: list[str]) -> StoredStats:
    for f in files:
        spark.sparkContext.addFile(f)
    return StoredStats(lang, files)


def stored(stats: DataFrame, path: str | None = None) -> dict[str, StoredStats]:
    """``stats`` written as a store at ``path``, or in the shared folder, and opened."""
    path = path or new_folder(stats.sparkSession, "lm-store")
    write_store(stats, path)
    return open_store(stats.sparkSession, path)
