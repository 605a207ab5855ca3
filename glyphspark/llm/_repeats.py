"""Which values of an owner another owner has too: values are dealt by hash in packed blocks.

A task packs the (owner, value) pairs of its rows; a value that several owners have there is told at once and passed on once,
without an owner, so a frequent value reaches the task of its bucket as one entry a block. Rows of one owner (copies of
a text) count as one. Buckets compare 32 bits of a value and the bucket itself, so an answer may rarely name a value that is
alone, and one may be told by several blocks; none that repeats is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glyphspark.llm import _vec as V

#: Pairs that a task packs before it passes them on.
BLOCK_VALUES = 700_000
NOBODY = np.int64(-(1 << 63))


def narrowed(value: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and 32 bits of each value: what repeats are told by."""
    return ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of a sorted array begin, and its end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), x.size) if x.size else np.zeros(1, np.int64)


def repeats(df: DataFrame, pairs: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int, with_values: bool = False) -> DataFrame:
    """(owner, n, values): owners with the number of their values that occur elsewhere, and packed if asked for those (narrowed).

    ``pairs`` yields owners (int64) and values (uint64) of a batch of ``df``. ``n`` may count a value once for every block that
    tells it, if rows of the owner are in several. Answers go back packed as well, by hash of the owner, so the rows
    between the stages grow with blocks and buckets, not with pairs.
    """
    kinds = [("to", pa.int32()), ("told", pa.bool_()), ("own", pa.binary()), ("n", pa.binary()), ("val", pa.binary())]

    def table(rows: list[tuple], of: type) -> pa.Table | pa.RecordBatch:
        return of.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

    def packed(to: np.ndarray, owner: np.ndarray, value: np.ndarray | None, told: bool, of: type) -> list[tuple]:
        """A row for each target: its owners, how many values each has, and the values."""
        order = np.lexsort((owner, to))
        to, owner = to[order], owner[order]
        value = None if value is None else value[order]
        cuts, rows = _cuts(to), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = _cuts(owner[a:b])
            rows.append((int(to[a]), told, owner[a:b][own[:-1]].tobytes(), np.diff(own).astype(np.int32).tobytes(), b"" if value is None else value[a:b].astype(of).tobytes()))
        return rows

    def several(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Where a sorted value has more than one owner; one that passed on a value without an owner counts too."""
        cuts = _cuts(value)
        return np.repeat(np.minimum.reduceat(owner, cuts[:-1]) != np.maximum.reduceat(owner, cuts[:-1]), np.diff(cuts))

    def once(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((owner, value))
        owner, value = owner[order], value[order]
        new = np.ones(owner.size, bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        return owner[new], value[new]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            owner, value = np.concatenate([o for o, _ in held]), narrowed(np.concatenate([v for _, v in held]), buckets)
            held.clear()
            order = np.argsort(value, kind="stable")
            owner, value = owner[order], value[order]
            more = several(owner, value)
            told, told_value = once(owner[more], value[more])
            rows = packed(np.full(told.size, value[0] % np.uint64(buckets), np.int64), told, told_value if with_values else None, True, np.uint64)
            first = _cuts(value)[:-1]
            owner, value = np.where(more, NOBODY, owner)[first], value[first]
            return table(rows + packed((value >> np.uint64(32)).astype(np.int64), owner, value, False, np.uint32), pa.RecordBatch)

        size = 0
        for b in batches:
            for owner, value in pairs(b):
                if value.size:
                    held.append((owner, value))
                    size += value.size
                if size >= BLOCK_VALUES:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def opened(rows: pa.Table, told: bool, of: type) -> tuple[np.ndarray, np.ndarray | None]:
        rows = rows.filter(rows["told"] if told else pc.invert(rows["told"]))
        own, n = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("own", np.int64), ("n", np.int32)))
        values = np.frombuffer(b"".join(rows["val"].to_pylist()), of)
        return np.repeat(own, n), values if values.size else None

    def meet(rows: pa.Table) -> pa.Table:
        bucket = np.uint64(rows["to"][0].as_py())
        owner, value = opened(rows, False, np.uint32)
        known, known_value = opened(rows, True, np.uint64)
        if owner.size:
            order = np.argsort(value, kind="stable")
            owner, value = owner[order], value[order]
            again = several(owner, value)
            again_owner, again_value = once(owner[again], value[again])
            again_owner, again_value = again_owner[again_owner != NOBODY], again_value[again_owner != NOBODY]
            known = np.concatenate([known, again_owner])
            if with_values:
                again_value = again_value.astype(np.uint64) | (bucket << np.uint64(32))
                known_value = again_value if known_value is None else np.concatenate([known_value, again_value])
        to = (V.mix(known.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        return table(packed(to, known, known_value if with_values else None, True, np.uint64), pa.Table)

    def gather(rows: pa.Table) -> pa.Table:
        owner, value = opened(rows, True, np.uint64)
        order = np.argsort(owner, kind="stable")
        cuts = _cuts(owner[order])
        values = [value[order][a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if value is not None else [b""] * (cuts.size - 1)
        return pa.table({"owner": pa.array(owner[order][cuts[:-1]], pa.int64()), "n": pa.array(np.diff(cuts), pa.int64()), "values": pa.array(values, pa.binary())})

    schema = "to int, told boolean, own binary, n binary, val binary"
    return df.mapInArrow(V.releasing(pack), schema).groupBy("to").applyInArrow(meet, schema).groupBy("to").applyInArrow(gather, "owner long, n long, values binary")
