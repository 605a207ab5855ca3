"""Op 11: phrase collocations by pivot partitioning (as in MG-FSM).

1. Word occurrences are counted by language; each task sums its own first. Words below the wanted count can't be in a candidate.
2. Every frequent word has a level, the logarithm of its count, in a table of hashed slots (16 MB at most). Levels, then hashes, give
   all tasks the same order of words, so every n-gram has one rarest word, its pivot.
3. Each occurrence of a word is a pivot: the fragment around it, three words either way, is rewritten, ending at pieces' ends, at
   infrequent words and at words rarer than the pivot. Equal fragments of a block of texts become one with a weight, and go to
   the task of their pivot, with two bytes for each of the most frequent words and eight for the others. Pivots with more
   occurrences than a task should hold are split over several.
4. A task mines its fragments for n-grams around their pivots, which no other fragment counts, and emits those with the wanted
   count (of split pivots all, which are summed once more).
5. Candidates get the counts of their parts by joins, and scores in exact decimals; a part that a longer candidate explains is dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.llm import _vec as V
from glyphspark.llm._spark import bounded_batches, checkpointed, join_counted

MIN_COUNT, MOST, TOP, PERCENT = 30, 4, 2000, 80
#: Words of a block of texts, of a mining task (about), slots of the level table as a power of two at most, words with short codes.
BLOCK_WORDS, TASK_WORDS, MAX_BITS, SHORT = 1_000_000, 500_000, 24, 65_535
#: Occurrences of a pivot that one task mines; pivots with more are split.
HOT_WORDS = 1_000_000
SIDE = MOST - 1
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """For slices of a batch (lang, text): keys of the words, first and end bytes, whether a word follows its forerunner in a piece, the text of each, and (bytes, languages)."""
    for part in V.slices(batch):
        data, offsets = V.text_bytes(part.column(1))
        value, start, end, at = V.words(data, offsets, apart=_APART)
        if not value.size:
            continue
        text = np.repeat(np.arange(part.num_rows), np.diff(at))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data], dtype=np.int32)])
        joined = np.zeros(value.size, bool)
        joined[1:] = (breaks[start[1:]] == breaks[end[:-1]]) & (text[1:] == text[:-1])
        langs = part.column(0).to_pylist()
        known = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
        key = V.mix(value ^ np.array([known[x] for x in langs], _U)[text])
        yield np.maximum(key, _U(1)), start, end, joined, text, [data, langs]


def word_counts(docs: DataFrame, block: int = 200_000) -> DataFrame:
    """(lang, word, key, n): occurrences of every word of ``docs`` (lang, text)."""

    def rows(held: Counter) -> pa.RecordBatch:
        lang, word, key = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(np.array(key, _U).view(np.int64)), pa.array(list(held.values()), pa.int64())], ["lang", "word", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for key, start, end, _, text, (data, langs) in tokens(b):
                uniq, first, n = np.unique(key, return_index=True, return_counts=True)
                raw = data.tobytes()
                for k, a, z, t, c in zip(uniq.tolist(), start[first].tolist(), end[first].tolist(), text[first].tolist(), n.tolist(), strict=True):
                    held[langs[t], raw[a:z].lower().decode(), k] += c
                if len(held) >= block:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return docs.select("lang", "text").mapInArrow(V.releasing(run), "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def level_of(n: Column, least: int) -> Column:
    """1 to 255, eight levels for each doubling of a count."""
    return F.least(F.lit(255), F.floor(8 * F.log2(n / least)) + 1).cast("int")


def level_table(frequent: DataFrame, least: int) -> tuple[bytes, int]:
    """A byte for each slot (the top bits of a key): the highest level of its frequent words, 0 where there is none; and the bits."""
    n = frequent.count()
    bits = min(MAX_BITS, max(16, int(np.ceil(np.log2(max(1, 16 * n))))))
    page = 1 << 14

    def filled(table: pa.Table) -> pa.Table:
        out = np.zeros(page, np.uint8)
        np.maximum.at(out, table["at"].to_numpy(), table["level"].to_numpy().astype(np.uint8))
        return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int64()), "levels": pa.array([out.tobytes()], pa.binary())})

    slot = F.shiftrightunsigned("key", 64 - bits)
    places = frequent.select(F.floor(slot / page).alias("page"), (slot % page).cast("int").alias("at"), level_of(F.col("n"), least).alias("level"))
    places = places.groupBy("page", "at").agg(F.max("level").alias("level"))
    out = bytearray(1 << bits)
    for r in places.groupBy("page").applyInArrow(filled, "page long, levels binary").collect():  # 16 MB at most
        out[r["page"] * page : (r["page"] + 1) * page] = r["levels"]
    return bytes(out), bits


def rewritten(key: np.ndarray, level: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fragments around every pivot as rows of codes (0: nothing), their weights, and the keys and levels' order of codes 1, 2 ..., rarest first.

    A word equal to the pivot may stand on its right only, so an n-gram belongs to its leftmost pivot.
    """
    n = key.size
    live = level > 0
    uniq, first, inverse = np.unique(key[live], return_index=True, return_inverse=True)
    order = np.lexsort((uniq, level[live][first]))
    rank = np.empty(uniq.size, np.int32)
    rank[order] = np.arange(1, uniq.size + 1)
    code = np.zeros(n + 2 * SIDE, np.int32)
    code[SIDE : SIDE + n][live] = rank[inverse]
    link = np.zeros(n + 2 * SIDE, bool)
    link[SIDE : SIDE + n] = joined
    own = code[SIDE : SIDE + n]
    rows = np.zeros((n, 2 * SIDE + 1), np.int32)
    rows[:, SIDE] = own
    right, left = own > 0, own > 0
    for s in range(1, SIDE + 1):
        there = code[SIDE + s : SIDE + s + n]
        right = right & link[SIDE + s : SIDE + s + n] & (there >= own)
        rows[:, SIDE + s] = np.where(right, there, 0)
        there = code[SIDE - s : SIDE - s + n]
        left = left & link[SIDE - s + 1 : SIDE - s + 1 + n] & (there > own)
        rows[:, SIDE - s] = np.where(left, there, 0)
    rows = rows[(rows[:, SIDE - 1] > 0) | (rows[:, SIDE + 1] > 0)]
    if not rows.size:
        return rows, np.zeros(0, np.int64), uniq[order]
    mixed = np.zeros(rows.shape[0], _U)
    for k in range(rows.shape[1]):
        mixed = (mixed + rows[:, k].astype(_U)) * _U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> _U(29)
    rows = rows[np.argsort(mixed, kind="stable")]
    cuts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))  # rows are compared themselves: a collision parts equal ones at most
    return rows[cuts], np.diff(np.append(cuts, rows.shape[0])), uniq[order]


def mined(left: np.ndarray, right: np.ndarray, ids: np.ndarray, weight: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams (rows of MOST ids, 0: none), their counts and whether their pivot is split, of fragments given by their words' ids (from 1) in order."""
    place = np.arange(2 * SIDE + 1)
    rows = np.zeros((left.size, place.size), np.int32)
    rows[(place >= SIDE - left[:, None]) & (place <= SIDE + right[:, None])] = ids
    grams, counts, parted = [], [], []
    for a in range(SIDE + 1):
        for b in range(SIDE + 1 - a):
            if a + b:
                has = np.flatnonzero((left >= a) & (right >= b))
                gram = np.zeros((has.size, MOST), np.int32)
                gram[:, : a + b + 1] = rows[has, SIDE - a : SIDE + b + 1]
                grams.append(gram)
                counts.append(weight[has])
                parted.append(split[has])
    gram, count, parted = np.concatenate(grams), np.concatenate(counts), np.concatenate(parted)
    if not count.size:
        return gram, count, parted
    # a pair of ids becomes one, and a pair of those one number: exact for any number of words
    packed = np.zeros(count.size, np.int64)
    for k in (0, 2):
        packed = packed << 32 | np.unique(gram[:, k].astype(np.int64) << 32 | gram[:, k + 1], return_inverse=True)[1]
    order = np.argsort(packed, kind="stable")
    cuts = np.flatnonzero(np.append(True, packed[order][1:] != packed[order][:-1]))
    return gram[order[cuts]], np.add.reduceat(count[order], cuts), parted[order[cuts]]


def ngram_counts(docs: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(g array<long>, a): keys and occurrences of all n-grams of 2 to MOST words of ``docs`` (lang, text) with at least ``min_count``."""
    spark = docs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= min_count)
    levels, bits = level_table(frequent, min_count)
    short = np.array(sorted(r[0] % (1 << 64) for r in frequent.orderBy(F.desc("n"), "key").limit(SHORT).select("key").collect()), _U)  # 64 k keys at most
    bins = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS)))
    # a pivot with more words than a task should hold is split; levels tell counts up to a twelfth
    shares = np.ceil(min_count * 2 ** (np.arange(256) / 8) / HOT_WORDS).astype(np.uint64)
    blob = short.tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = np.frombuffer(levels, np.uint8), np.frombuffer(blob, _U)
        task, turn, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch | None:
            key, level, joined = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            rows, weight, keys = rewritten(key, level, joined)
            if not weight.size:
                return None
            share = shares[table[(keys >> _U(64 - bits)).astype(np.int64)]]
            parted = share > 1
            salt = V.mix(np.array([task << 24 | turn], _U)) % share
            to = (V.mix(keys + salt * _U(0x9E3779B97F4A7C15)) % _U(bins)).astype(np.int64)[rows[:, SIDE] - 1]
            order = np.argsort(to, kind="stable")
            rows, weight, to = rows[order], weight[order], to[order]
            there = rows > 0
            left, right = there[:, :SIDE].sum(axis=1), there[:, SIDE + 1 :].sum(axis=1)
            shape = (left | right << 2 | parted[rows[:, SIDE] - 1].astype(np.int64) << 4).astype(np.uint8)
            at = np.minimum(np.searchsorted(top, keys), max(0, top.size - 1))
            code = np.where(top[at] == keys, at, SHORT).astype(np.uint16) if top.size else np.full(keys.size, SHORT, np.uint16)
            cells = rows[there] - 1
            codes = code[cells]
            longer = codes == SHORT
            far, words_before, far_before = keys[cells[longer]], np.concatenate([[0], np.cumsum(left + right + 1)]), np.concatenate([[0], np.cumsum(longer)])
            cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), to.size)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                p, q = words_before[a], words_before[b]
                out.append((int(to[a]), shape[a:b].tobytes(), weight[a:b].astype(np.int32).tobytes(), codes[p:q].tobytes(), far[far_before[p] : far_before[q]].tobytes()))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["bin", "shape", "weight", "code", "key"])

        for b in batches:
            for key, _, _, joined, _, _ in tokens(b):
                held.append((key, table[(key >> _U(64 - bits)).astype(np.int64)], joined))
                size += key.size
                if size >= BLOCK_WORDS:
                    if (out := flush()) is not None:
                        yield out
                    turn, size = turn + 1, 0
        if size and (out := flush()) is not None:
            yield out

    def mine(rows: pa.Table) -> pa.Table:
        try:
            return counted(rows)
        finally:
            V.release()

    def counted(rows: pa.Table) -> pa.Table:
        top = np.frombuffer(blob, _U)
        shape, weight, code, far = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("shape", np.uint8), ("weight", np.int32), ("code", np.uint16), ("key", _U)))
        others, place = np.unique(far, return_inverse=True)
        ids = code.astype(np.int32)
        ids[code == SHORT] = SHORT + place
        keys = np.concatenate([top, np.zeros(SHORT - top.size, _U), others])
        gram, count, parted = mined((shape & 3).astype(np.int64), (shape >> 2 & 3).astype(np.int64), ids + 1, weight.astype(np.int64), (shape >> 4 & 1).astype(bool))
        keep = parted | (count >= min_count)
        gram, count = gram[keep], count[keep]
        size = (gram > 0).sum(axis=1)
        flat = keys[gram[gram > 0] - 1].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int64()))
        return pa.table({"g": lists, "a": pa.array(count, pa.int64())})

    packed = docs.select("lang", "text").mapInArrow(V.releasing(pack), "bin int, shape binary, weight binary, code binary, key binary")
    found = packed.groupBy("bin").applyInArrow(mine, "g array<long>, a long")
    return found.groupBy("g").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(g, a, lang, l, r, score): of all cuts the one that scores lowest, of equal ones the first."""
    parts = grams.select("g", "a", F.lit(None).cast("string").alias("lang")).union(words.select(F.array("key").alias("g"), F.col("n").alias("a"), "lang"))
    parts = checkpointed(parts)
    left, right = (parts.select(F.col("g").alias(f"_{x}"), F.col("a").alias(x), *([F.col("lang")] if x == "l" else [])) for x in "lr")
    cuts = grams.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.withColumns({"_l": F.slice("g", F.lit(1), F.col("k")), "_r": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))})
    both = cuts.join(left.hint("shuffle_merge"), "_l").join(right.hint("shuffle_merge"), "_r")
    score = F.call_function("div", _wide(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), _wide(F.col("l")) + _wide(F.col("r")))
    best = both.groupBy("g").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("g", "a", "lang", "best.l", "best.r", "best.score")


def explained(grams: DataFrame, percent: int) -> DataFrame:
    """(g) of n-grams inside a longer one that has ``percent`` of their occurrences at least."""
    subs = None
    for n in range(3, MOST + 1):
        inner = F.array(*[F.slice("g", i, k) for k in range(2, n) for i in range(1, n - k + 2)])
        own = grams.where(F.size("g") == n).select(F.explode(inner).alias("g"), "a")
        subs = own if subs is None else subs.union(own)
    most = subs.groupBy("g").agg(F.max("a").alias("longer"))
    return grams.join(most.hint("shuffle_merge"), "g").where(_wide(F.col("longer")) * 100 >= _wide(F.col("a")) * percent).select("g")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """The ``top`` phrases of two to four words of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; words are what spaces and tabs part. A phrase has ``a``
    occurrences, ``min_count`` at least; its cut into parts with ``l`` and ``r`` occurrences scores floor(2000000 a / (l + r)), and
    the lowest cut counts. Phrases within a longer one that has ``percent`` of their occurrences are left out. n is the number of the
    language's words. Order: score, then a, both descending, then phrase. A null lang is ``und``; null, empty and wordless
    texts add nothing, repeated rows count again, texts of any length are read whole. Other columns are ignored; an empty table
    gives an empty one. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = checkpointed(word_counts(docs))
    totals = checkpointed(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= min_count).select("lang", "word", "key", "n")
    grams = checkpointed(ngram_counts(docs, words, min_count))
    kept = scored(grams, frequent).join(explained(grams, percent).hint("shuffle_merge"), "g", "left_anti")
    # a share of each language's phrases is ranked by itself first, with all that tie
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(salts)))
    kept = checkpointed(kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("_rank") <= top).drop("_rank"))
    spelled = join_counted(kept.select("g", F.posexplode("g").alias("at", "key")), frequent.select("key", "word"), "key", "inner")
    spelled = spelled.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(spelled, "g")
    for by in (["lang", "salt"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best, "phrase"))).where(F.col("rank") <= top)
    return join_counted(named, totals, "lang", "inner").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
