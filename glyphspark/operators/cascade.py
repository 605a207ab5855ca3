"""Replacement rules that count their matches over all lines of a key, in order, and see what earlier rules wrote.

What a rule counts in a block of lines depends on how often it and the rules before it have matched so far, so blocks can't be
rewritten alone. Lines are laid out once, in ranges of key and order (the blocks), and written. Blocks then report, for all rules
together, how many matches they add, given the counts they are told to begin with; the reports are summed in order, and blocks
whose beginning changes report again. The first rule's sums are right after one round, the k-th rule's after k at most, and only counts
modulo each rule's number matter, so in practice a few rounds do whatever the number of rules is. A last pass rewrites. All passes
stream over their blocks; the driver holds a number for each block, key and rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.operators.shared import checkpointed

#: Combining marks: one that follows a match makes its last letter another glyph.
_MARK = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_MARKS = np.array([c for c in range(0x10000) if _MARK.match(chr(c))], np.uint32)


@dataclass(frozen=True)
class Rule:
    """Every ``every``-th occurrence of ``old`` becomes ``new``."""

    old: str
    new: str
    every: int = 1


def overlaps_itself(pattern: str) -> bool:
    """True if a match can begin inside another one."""
    return any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def walk(text: str, rule: Rule, count: int) -> tuple[str, int]:
    """A text with every n-th match replaced, given the matches before it, and the matches up to its end.

    A match that is replaced is consumed, one that isn't moves on by a character.
    """
    out, at, size = [], 0, len(rule.old)
    while (found := text.find(rule.old, at)) >= 0:
        out.append(text[at:found])
        at = found + 1
        if _MARK.match(text, found + size):
            out.append(text[found])
            continue
        if count % rule.every == rule.every - 1:
            out.append(rule.new)
            at = found + size
        else:
            out.append(text[found])
        count += 1
    return "".join(out) + text[at:], count


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def applied(codes: np.ndarray, rule: Rule, count: int) -> tuple[np.ndarray, int]:
    """``walk`` over code points, all matches at once; of a pattern that overlaps itself one by one."""
    if overlaps_itself(rule.old):
        text, count = walk(_text(codes), rule, count)
        return _codes(text), count
    old, new = _codes(rule.old), _codes(rule.new)
    at = np.flatnonzero(codes[: max(codes.size - old.size + 1, 0)] == old[0])
    for k in range(1, old.size):
        at = at[codes[at + k] == old[k]]
    if at.size:
        after = codes[np.minimum(at + old.size, codes.size - 1)]
        if (after >= 0x300).any():  # a mark may follow
            at = at[~((at + old.size < codes.size) & np.isin(after, _MARKS))]
    hits = at[rule.every - 1 - count % rule.every :: rule.every]
    if hits.size:
        codes = codes.copy()
        for k in range(min(old.size, new.size)):
            codes[hits + k] = new[k]
        if new.size < old.size:
            keep = np.ones(codes.size, bool)
            for k in range(new.size, old.size):
                keep[hits + k] = False
            codes = codes[keep]
        elif new.size > old.size:
            codes = np.insert(codes, np.repeat(hits + old.size, new.size - old.size), np.tile(new[old.size :], hits.size))
    return codes, count + at.size


#: Characters that all rules are applied to before the next ones.
CHUNK = 1 << 16


def _joined(lines: list[str], rules: list[Rule]) -> Iterator[tuple[str | None, str]]:
    """Lines, some at a time, as one text with a separator that neither lines nor rules have; each alone where none is found."""
    names = "".join(r.old + r.new for r in rules)
    at = size = 0
    for k, line in enumerate(lines, 1):
        size += len(line)
        if size < CHUNK and k < len(lines):
            continue
        own, at, size = lines[at:k], k, 0
        used = "".join(own) + names
        sep = next((s for s in "\n\x1e\x00" if s not in used), None)
        if sep:
            yield sep, sep.join(own)
        else:
            yield from ((None, x) for x in own)


def cascade(lines: list[str], rules: list[Rule], counts: list[int], on_rule=None) -> list[str]:
    """All rules over lines, in order; ``counts`` goes on. ``on_rule`` (index, text) sees the text before a rule that overlaps itself is applied."""
    out = []
    for sep, text in _joined(lines, rules) if lines else ():
        codes = _codes(text)
        for k, rule in enumerate(rules):
            if on_rule and overlaps_itself(rule.old):
                on_rule(k, _text(codes))
            codes, counts[k] = applied(codes, rule, counts[k])
        text = _text(codes)
        out += text.split(sep) if sep else [text]
    return out


def _segments(batch: pa.RecordBatch, key: str, text: str) -> Iterator[tuple[str | None, list[str | None]]]:
    rows = zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True)
    for name, own in groupby(rows, key=lambda r: r[0]):
        yield name if name is None else str(name), [x for _, x in own]


def replace_in_order(lines: DataFrame, rules: list[Rule], key: str, order: tuple[str, str], text: str, blocks: int | None = None) -> DataFrame:
    """``lines`` with the column ``text`` rewritten by the rules; see the module. Null texts stay null; null keys are a key of their own."""
    spark = lines.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(lines.repartitionByRange(blocks, key, *order).sortWithinPartitions(key, *order).withColumn("_block", F.spark_partition_id()))
    lapping = [k for k, r in enumerate(rules) if r.every > 1 and overlaps_itself(r.old)]
    begin: dict[tuple, list[int]] = {}
    reports: dict[tuple, tuple[list[int], list[list[int]]]] = {}

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, start, tables = None, [], [], []

        def seen(k: int, body: str) -> None:
            if k in lapping:
                own = tables[lapping.index(k)]
                own[:] = [n + walk(body, rules[k], r + n)[1] - (r + n) for r, n in enumerate(own)]

        def told() -> pa.RecordBatch:
            row = {"block": now[0], "key": now[1], "adds": [c - s for c, s in zip(counts, start, strict=True)], "tables": tables}
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int32()), ("key", pa.string()), ("adds", pa.list_(pa.int64())), ("tables", pa.list_(pa.list_(pa.int64())))]))

        for batch in batches:
            block = batch.column("_block")[0].as_py() if batch.num_rows else 0
            for name, own in _segments(batch, key, text):
                if (block, name) != now:
                    if now is not None:
                        yield told()
                    now = (block, name)
                    start = begin.get(now, [0] * len(rules))
                    counts, tables = list(start), [[0] * rules[k].every for k in lapping]
                cascade([x for x in own if x is not None], rules, counts, seen)
        if now is not None:
            yield told()

    todo = None
    source = laid.select(F.col(key).cast("string").alias(key), text, "_block")
    while todo is None or todo:
        rows = source if todo is None else source.where(F.col("_block").isin(sorted({b for b, _ in todo})))
        for r in rows.mapInArrow(report, "block int, key string, adds array<long>, tables array<array<long>>").collect():  # a row a block and key
            reports[r["block"], r["key"]] = (r["adds"], r["tables"])
        todo, so_far = set(), {}
        for place in sorted(reports, key=lambda p: p[0]):
            adds, tables = reports[place]
            count = so_far.setdefault(place[1], [0] * len(rules))
            if count != begin.get(place, [0] * len(rules)):
                todo.add(place)
                begin[place] = list(count)
            more = list(adds)
            for k, own in zip(lapping, tables, strict=True):
                more[k] = own[count[k]]
            so_far[place[1]] = [(c + a) % r.every for c, a, r in zip(count, more, rules, strict=True)]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, []
        for batch in batches:
            out: list[str | None] = []
            block = batch.column("_block")[0].as_py() if batch.num_rows else 0
            for name, own in _segments(batch, key, text):
                if (block, name) != now:
                    now, counts = (block, name), list(begin.get((block, name), [0] * len(rules)))
                done = iter(cascade([x for x in own if x is not None], rules, counts))
                out += [None if x is None else next(done) for x in own]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return laid.mapInArrow(rewrite, laid.schema).drop("_block")

