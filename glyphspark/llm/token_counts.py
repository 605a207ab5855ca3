"""Op 7: token counts by a library tokenizer, each distinct pre-token counted once in the whole corpus.

For vocabularies that drop white space (word files) nothing but counts is ever made of a text:

1. Texts are cut into pre-tokens in blocks of bounded bytes. A block keeps, for each document, the frequencies of its distinct
   pre-tokens, as numbers into the block's own list of strings; the list is dealt by hash. This is written to the
   shared folder, so what follows sees one and the same cut even if executors are lost.
2. A task that gets a share of the strings of all blocks has the library count each distinct one once, and answers
   every block. A pre-token that all documents hold comes once from each block, so no key is hot.
3. Answers meet their block's frequencies (a join by block), and frequency times count is summed by document.

Pieces whose cut isn't decided by their bytes (``_pretokens``) count as one pre-token, between white space. For vocabularies that
keep white space (sentencepiece models, byte-level files) the whole text goes to the library, document by document.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._pretokens import cuts_words, distinct, pretokens
from glyphspark.llm._spark import checkpointed

#: Text bytes that are cut at once, that make a block (about), and whose pre-tokens one task counts (about).
SLICE_BYTES, BLOCK_BYTES, TASK_BYTES = 1 << 21, 8 << 20, 64 << 20
#: Strings that the library gets at once.
BATCH = 20_000
_PACKED = "block long, bucket int, ids binary, sizes binary, body binary, more binary"


def drops_space(spec: dict) -> bool:
    """True if the file's normaliser and splitter leave no white space in any pre-token, so that texts may be cut there."""
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])


def library(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens of strings by the library that the file is for."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _pack(x: np.ndarray, kind: type = np.int32) -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _unpack(x: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


class Block:
    """Pre-token frequencies of some documents: strings are numbered as they come, frequencies go by document and number."""

    def __init__(self, words: bool):
        self.words, self.bytes = words, 0
        self.number: dict[int, int] = {}
        self.strings: list[bytes] = []
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        data, offsets = V.text_bytes(texts)
        value, start, end, at = pretokens(data, offsets, self.words)
        value, first, which = distinct(value)
        raw, number, strings, own = data.tobytes(), self.number, self.strings, []
        for key, a, b in zip(value.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            if (k := number.get(key)) is None:
                k = number[key] = len(strings)
                strings.append(raw[a:b])
            own.append(k)
        text = np.repeat(np.arange(at.size - 1), np.diff(at))
        pair, times = np.unique(text.astype(np.int64) << 32 | np.array(own, np.int64)[which], return_counts=True) if which.size else (which, which)
        self.ids.append(ids)
        self.sizes.append(np.diff(offsets))
        self.kinds.append(np.bincount(pair >> 32, minlength=at.size - 1))
        self.numbers.append(pair & 0xFFFFFFFF)
        self.times.append(times)
        self.bytes += data.size

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        """The frequencies (bucket -1) and the strings by bucket."""
        gaps = np.diff(np.concatenate(self.numbers), prepend=0)
        ids = pa.chunked_array(self.ids).combine_chunks()
        held = np.column_stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)])
        out = [(block, -1, _pack(held, np.int64), _pack(np.concatenate(self.sizes), np.int64), _pack(gaps), _pack(np.concatenate([*self.kinds, *self.times])))]
        keys = np.fromiter(self.number, np.uint64, len(self.number))
        bucket = (V.mix(keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b] : cuts[b + 1]]
            out.append((block, b, None, _pack(mine), zstandard.compress(b"\n".join([self.strings[k] for k in mine.tolist()]), 1), None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "bucket", "ids", "sizes", "body", "more"])


def _blocks(docs: DataFrame, buckets: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = TaskContext.get().partitionId() << 32, Block(words)
        for whole in batches:
            for part in V.slices(whole, limit=SLICE_BYTES):
                held.add(part.column(0), part.column(1))
                if held.bytes >= BLOCK_BYTES:
                    yield held.rows(name, buckets)
                    name, held = name + 1, Block(words)
        if held.ids:
            yield held.rows(name, buckets)

    return docs.mapInArrow(V.releasing(run), _PACKED)


def _answers(asked: DataFrame, path: str) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(x).split(b"\n") for x in rows["body"].to_pylist()]
        table = dict.fromkeys(s for own in lists for s in own)
        strings, count = list(table), library(path)
        for k in range(0, len(strings), BATCH):
            part = strings[k : k + BATCH]
            table.update(zip(part, count([x.decode() for x in part]), strict=True))
        more = [_pack(np.fromiter((table[s] for s in own), np.int64, len(own))) for own in lists]
        empty = pa.nulls(rows.num_rows, pa.binary())
        return pa.table([rows["block"], rows["bucket"], empty, rows["sizes"], empty, pa.array(more, pa.binary())], names=["block", "bucket", "ids", "sizes", "body", "more"])

    return asked.groupBy("bucket").applyInArrow(run, _PACKED)


def _sums(rows: DataFrame, limit: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["bucket"] < 0)
        held, sizes = _unpack(own["ids"], np.int64).reshape(-1, 2), _unpack(own["sizes"], np.int64)
        numbers = np.cumsum(_unpack(own["body"]), dtype=np.int64)
        kinds, times = np.split(_unpack(own["more"]).astype(np.int64), [sizes.size])
        count = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
        for r in rows:
            if r["bucket"] >= 0:
                count[_unpack(r["sizes"])] = _unpack(r["more"])
        total = np.concatenate([[0], np.cumsum(times * count[numbers])])[np.concatenate([[0], np.cumsum(kinds)])]
        n = np.diff(total)
        return pa.table({"doc_id": pa.array(held[:, 1], pa.int64(), mask=held[:, 0] > 0), "n_bytes": pa.array(sizes), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return rows.groupBy("block").applyInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _whole(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Counts of whole texts, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = library(path)
        for whole in batches:
            for batch in V.slices(whole, limit=SLICE_BYTES):
                n = np.array(count(batch.column(1).to_pylist()), np.int64)
                sizes = np.diff(V.text_bytes(batch.column(1))[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(V.releasing(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every text of ``docs`` (doc_id, text; other columns are ignored) by the tokenizer file at ``path``.

    Rows: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``). A null or empty text counts 0. Special
    strings inside a text become special tokens as the library's default has it. Rows repeat as the input's do; a null
    doc_id stays null; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spec = json.load(open(path, encoding="utf-8")) if path.endswith(".json") else {}
    if not spec or not drops_space(spec):
        return _whole(docs, path, limit)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    packed = checkpointed(_blocks(docs, int(buckets), cuts_words(spec)))
    own, asked = packed.where("bucket < 0"), packed.where("bucket >= 0")
    return _sums(own.unionByName(_answers(asked, path)), limit)
