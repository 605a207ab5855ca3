"""Evaluation: error rates, macro averages, alignments and error analysis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphspark.functions.charset import DECOMPOSED, is_combining, normalize_space, parse, remove_punctuation
from glyphspark.operators import bands
from glyphspark.operators.shared import dealt

# Names of the eight metrics (two end in two spaces).
METRICS = ["CER, keep punc, allow f->s", "CER, keep punc  ", "CER, remove punc, allow f->s", "CER, remove punc", "WER, keep punc, allow f->s", "WER, keep punc  ", "WER, remove punc, allow f->s", "WER, remove punc"]


def allowed(guess: str, gold: str, f_for_s: bool) -> bool:
    """True if two glyphs count as equal; with ``f_for_s`` a guessed f may stand for an s, in words as in letters."""
    if guess == gold:
        return True
    if not f_for_s or len(guess) != len(gold):
        return False
    if len(guess) == 1:
        return guess == "f" and gold == "s"
    return guess.replace("f", "*").replace("s", "*") == gold.replace("s", "*")


def _columns(guess: list[str], gold: list[str], f_for_s: bool, start: tuple[int, int] | None = None):
    """After each guessed glyph: where the distance to the gold text's beginnings rises and where it falls by one, as bits, and where it is that of both without their last glyph.

    Myers' bit vectors, as long as the gold text: a step is a few operations on whole numbers, and nothing of quadratic size is
    held. The distance to the first k gold glyphs is the number of guessed ones, plus rises, less falls below k. ``start`` is the column before.
    """
    places: dict[str, int] = {}
    for k, x in enumerate(gold):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(gold)) - 1
    rise, fall = start or (every, 0)
    match: dict[str, int] = {}
    for g in guess:
        if (same := match.get(g)) is None:
            same = places.get(g, 0)
            if f_for_s:
                for x, at in places.items():
                    if allowed(g, x, True):
                        same |= at
            match[g] = same
        down = same | fall
        across = (((same & rise) + rise) ^ rise) | same
        up, back = fall | ~(across | rise), rise & across
        up, back = up << 1 | 1, back << 1
        level = across | fall
        rise, fall = (back | ~(down | up)) & every, up & down & every
        yield rise, fall, level


def edit_distance(guess: list[str], gold: list[str], f_for_s: bool = False) -> int:
    """Cost of a cheapest alignment. What both begin and end with is left out first; the rest is walked over its shorter side's bits."""
    at, end, other = 0, len(guess), len(gold)
    while at < end and at < other and guess[at] == gold[at]:
        at += 1
    while end > at and other > at and guess[end - 1] == gold[other - 1]:
        end, other = end - 1, other - 1
    guess, gold = guess[at:end], gold[at:other]
    if not guess or not gold:
        return len(guess) + len(gold)
    rise, fall = (1 << len(gold)) - 1, 0
    for rise, fall, _ in _columns(guess, gold, f_for_s):  # noqa: B007
        pass
    return len(guess) + rise.bit_count() - fall.bit_count()


#: Alignments of up to this many cells keep all columns (three bits a cell).
KEEP_CELLS = 1 << 23


def align(guess: list[str], gold: list[str], f_for_s: bool = False) -> list[tuple[str, str | None, str | None]]:
    """(op, guess, gold) of a cheapest alignment: = equal, S substituted, I and D: glyphs of one side only. Ties: equal, S, I, D.

    It is traced from the end; where glyphs are equal, that step is always a cheapest one. Of a long line's columns only each root-th is kept;
    those between two of them are made again when the trace comes to them, so what is held grows with the line times the root
    of its length, in bits.
    """
    step = 1 if len(guess) * len(gold) <= KEEP_CELLS else isqrt(len(guess))
    kept = [((1 << len(gold)) - 1, 0, 0)]
    for k, column in enumerate(_columns(guess, gold, f_for_s), 1):
        if k % step == 0:
            kept.append(column)

    @lru_cache(2)
    def columns(block: int) -> list[tuple[int, int, int]]:
        between = guess[block * step : (block + 1) * step - 1]
        return [kept[block], *(_columns(between, gold, f_for_s, kept[block][:2]) if between else ())]

    i, j, out = len(guess), len(gold), []
    while i and j:
        if guess[i - 1] == gold[j - 1] or (f_for_s and allowed(guess[i - 1], gold[j - 1], True)):
            i, j = i - 1, j - 1
            out.append(("=", guess[i], gold[j]))
            continue
        rise, _, level = columns(i // step)[i % step]
        if not level >> j - 1 & 1:
            i, j = i - 1, j - 1
            out.append(("S", guess[i], gold[j]))
        elif rise >> j - 1 & 1:
            j -= 1
            out.append(("I", None, gold[j]))
        else:
            i -= 1
            out.append(("D", guess[i], None))
    out += [("I", None, x) for x in gold[:j][::-1]] + [("D", x, None) for x in guess[:i][::-1]]
    return out[::-1]


def glyphs(text: str, diacritics_apart: bool = False) -> list[str]:
    """Characters of a text; with ``diacritics_apart`` marks are glyphs before their letter, sorted."""
    if not diacritics_apart and "\\" not in text and (text.isascii() or not any(map(is_combining, set(text)))):
        return [DECOMPOSED.get(c, c) for c in text]  # nothing to parse: a code point is a glyph
    out = []
    for base, marks in parse(text, strict=False):
        out += [*sorted(marks), base] if diacritics_apart else [base + "".join(marks)]
    return out


def prepared(text: Column, punctuation: bool = True) -> Column:
    return normalize_space(text) if punctuation else remove_punctuation(text)


def _folded(guess: str) -> str | None:
    """What a guessed glyph and a gold one (``_folded_gold``) share where ``allowed`` takes an f for an s."""
    return guess.replace("f", "*").replace("s", "*") if len(guess) > 1 else "s" if guess == "f" else None


def _folded_gold(gold: str) -> str | None:
    return gold.replace("s", "*") if len(gold) > 1 else "s" if gold == "s" else None


@dataclass
class Cut:
    """Glyphs of many pairs, numbered: characters for all pairs together, words for each pair.

    A glyph's name is found in ``names`` (of guesses, of gold texts) at the entry that ``entries`` has for it. ``fold`` and ``loose`` are
    what ``bands.walked`` takes with f for s.
    """

    guess: bands.Side
    gold: bands.Side
    size: int
    names: tuple[list[str], list[str]]
    entries: tuple[np.ndarray, np.ndarray]
    fold: tuple[bands.Side, bands.Side, int] | None = None
    loose: tuple[np.ndarray, np.ndarray] | None = None

    def own(self, k: int) -> list[list[str]]:
        return [[names[e] for e in at[side.starts[k] : side.starts[k] + side.sizes[k]].tolist()] for side, names, at in zip((self.guess, self.gold), self.names, self.entries, strict=True)]


def _sized(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(codes or [np.zeros(0, np.int64)]), np.array([x.size for x in codes], np.int64)


def cut_characters(guess: list[str], gold: list[str], f_for_s: bool = False, points: bool = False) -> Cut:
    """Glyphs of texts; with ``points`` their code points as they are."""
    others: dict[str, int] = {}

    def codes(text: str) -> np.ndarray:
        if text.isascii() and "\\" not in text:
            return np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.array([ord(g) if len(g) == 1 else 0x110000 + others.setdefault(g, len(others)) for g in glyphs(text)], np.uint32)

    def side(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        if points or (whole.isascii() and "\\" not in whole):
            return np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.array([len(x) for x in texts], np.int64)
        return _sized([codes(x) for x in texts])

    (a, sizes_a), (b, sizes_b) = side(guess), side(gold)
    there = np.zeros(max(a.max(initial=0), b.max(initial=0)) + 1, bool)
    there[a] = there[b] = True
    longer = list(others)
    names = [chr(c) if c < 0x110000 else longer[c - 0x110000] for c in np.flatnonzero(there).tolist()]
    number = np.cumsum(there) - 1
    cut = Cut(bands.Side(number[a], sizes_a), bands.Side(number[b], sizes_b), len(names), (names, names), (number[a], number[b]))
    if f_for_s:
        g, h, loose = _shared(names)
        cut.fold = cut.guess.recoded(g[cut.guess.codes]), cut.gold.recoded(h[cut.gold.codes]), int(max(g.max(), h.max())) + 1
        cut.loose = loose[cut.guess.codes], loose[cut.gold.codes]
    return cut


def _shared(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each name what it is as a guessed glyph and as a gold one, from 2 on where f for s makes it equal to others; and classes that equal glyphs share."""
    ids, alike = {}, {}
    guess, gold, loose = np.ones(max(len(names), 1), np.int64), np.zeros(max(len(names), 1), np.int64), np.arange(max(len(names), 1))
    for k, x in enumerate(names):
        if "f" in x or "s" in x or "*" in x:  # others are equal to themselves alone
            if (key := _folded(x)) is not None:
                guess[k] = ids.setdefault(key, len(ids) + 2)
            if (key := _folded_gold(x)) is not None:
                gold[k] = ids.setdefault(key, len(ids) + 2)
            loose[k] = alike.setdefault(x.replace("f", "*").replace("s", "*"), k)
    return guess, gold, loose


def _by_pair(codes: np.ndarray, pair: np.ndarray, pairs: int) -> tuple[np.ndarray, int]:
    """Codes numbered anew for each pair, and how many a pair has at most."""
    most = int(codes.max(initial=0)) + 1
    found, place = np.unique(pair * most + codes, return_inverse=True)
    first = np.searchsorted(found, np.arange(pairs + 1) * most)
    return place.reshape(-1) - first[pair], int(np.diff(first).max(initial=1))


def cut_words(guess: list[str], gold: list[str], f_for_s: bool = False) -> Cut:
    words = pc.split_pattern(pa.array(guess + gold, pa.large_string()), " ")
    sizes = np.split(np.diff(words.offsets.to_numpy()).astype(np.int64), [len(guess)])
    pair = np.concatenate([np.repeat(np.arange(len(gold)), n) for n in sizes])
    numbered = words.flatten().dictionary_encode()
    entries, names = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_pylist()
    half = int(sizes[0].sum())
    both = lambda x: (x[:half], x[half:])
    codes, size = _by_pair(entries, pair, len(gold))
    a, b = (bands.Side(x, n) for x, n in zip(both(codes), sizes, strict=True))
    cut = Cut(a, b, size, (names, names), both(entries))
    if f_for_s:
        g, h, loose = _shared(names)
        keys = np.concatenate([g[entries[:half]], h[entries[half:]]])
        own, most = _by_pair(keys, pair, len(gold))
        fold = both(np.where(keys > 1, own + 2, keys))
        cut.fold = a.recoded(fold[0]), b.recoded(fold[1]), most + 2
        cut.loose = both(_by_pair(loose[entries], pair, len(gold))[0])
    return cut


_CODES = {"=": bands.EQUAL, "S": bands.SUBSTITUTED, "I": bands.INSERTED, "D": bands.DELETED}


def compared(cut: Cut, f_for_s: bool = False, keep: bool = False, only: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Costs of all pairs (of those in ``only``) and, with ``keep``, their steps: ``edit_distance`` and ``align`` for many pairs."""

    def alone(k: int) -> tuple[int, np.ndarray | None]:
        guess, gold = cut.own(k)
        if not keep:
            return edit_distance(guess, gold, f_for_s), None
        steps = np.array([_CODES[s[0]] for s in align(guess, gold, f_for_s)], np.uint8)
        return int(np.count_nonzero(steps)), steps

    return bands.walked(cut.guess, cut.gold, cut.size, alone, cut.fold if f_for_s else None, cut.loose if f_for_s else None, keep, only)


#: Characters that are compared at once.
CHUNK = 1 << 22


def _chunks(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield slice(at, k)
            at, size = k, 0
        size += len(x)
    if texts:
        yield slice(at, len(texts))


def _eight(guess: list[str], gold: list[str], bare_guess: list[str], bare_gold: list[str]) -> np.ndarray:
    """For each row costs in the order of METRICS, then sizes of gold texts. What has no punctuation isn't compared again."""
    n = len(guess)
    other = [k for k in range(n) if (guess[k], gold[k]) != (bare_guess[k], bare_gold[k])]
    a, b = guess + [bare_guess[k] for k in other], gold + [bare_gold[k] for k in other]
    bare = np.arange(n)
    bare[other] = np.arange(n, len(a))
    may = np.array(["f" in x and "s" in y for x, y in zip(a, b, strict=True)], bool)
    costs, sizes = [], []
    for cut in (cut_characters(a, b, True), cut_words(a, b, True)):
        plain = compared(cut)[0]
        again = np.flatnonzero(may & (plain > 0))
        folded = plain.copy()
        folded[again] = compared(cut, True, only=again)[0][again]
        costs += [folded[:n], plain[:n], folded[bare], plain[bare]]
        sizes += [cut.gold.sizes[:n]] * 2 + [cut.gold.sizes[bare]] * 2
    return np.stack(costs + sizes, 1)


def scores(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(*key, metric, cost, gold_len, score) of all eight metrics for pairs (*key, guess, gold).

    Score is cost by gold length, null for an empty gold text (CER); an empty text is one empty word (WER). All metrics of a pair are
    taken at once: glyphs are cut once, and what leaves a text as it was isn't compared again.
    """
    texts = dealt(pairs, *key).select(*key, *[prepared(F.coalesce(c, F.lit("")), keep).alias(f"{c}_{keep}") for c in ("guess", "gold") for keep in (True, False)])

    @F.pandas_udf("array<long>")
    def measured(guess: pd.Series, gold: pd.Series, bare_guess: pd.Series, bare_gold: pd.Series) -> pd.Series:
        columns = [x.tolist() for x in (guess, gold, bare_guess, bare_gold)]
        return pd.Series([row for own in _chunks(columns[1]) for row in _eight(*[x[own] for x in columns])], dtype=object)

    rows = [F.struct(F.lit(m).alias("metric"), F.get("_c", F.lit(i)).alias("cost"), F.get("_c", F.lit(i + len(METRICS))).alias("gold_len")) for i, m in enumerate(METRICS)]
    out = texts.select(*key, measured("guess_True", "gold_True", "guess_False", "gold_False").alias("_c")).select(*key, F.inline(F.array(*rows)))
    return out.withColumn("score", F.col("cost") / F.nullif(F.col("gold_len"), F.lit(0)))


def char_costs(pairs: DataFrame, key: list[str], f_for_s: bool = False) -> DataFrame:
    """(*key, cost, gold_len, score) of characters: the lines of a batch are compared together.

    With ``f_for_s`` texts are folded, which is exact where no guess has an s.
    """
    fold = (lambda c: F.translate(c, "f", "s")) if f_for_s else (lambda c: c)
    texts = dealt(pairs, *key).select(*key, fold(prepared(F.col("guess"))).alias("_g"), fold(prepared(F.col("gold"))).alias("_h"))

    @F.pandas_udf("long")
    def measured(guess: pd.Series, gold: pd.Series) -> pd.Series:
        there = (guess.notna() & gold.notna()).to_numpy()
        a, b = guess[there].tolist(), gold[there].tolist()
        found = [c for own in _chunks(b) for c in compared(cut_characters(a[own], b[own], points=True))[0].tolist()]
        return pd.Series(found, np.flatnonzero(there), "Int64").reindex(range(len(there)))

    out = texts.select(*key, measured("_g", "_h").alias("cost"), F.length("_h").cast("long").alias("gold_len"))
    return out.withColumn("score", F.col("cost") / F.nullif(F.col("gold_len"), F.lit(0)))


def macro_average(score: DataFrame, by: list[str]) -> DataFrame:
    return score.groupBy(*by).agg(F.avg("score").alias("score"), F.count("score").alias("docs"))


#: Steps of alignments that a task hands over at once.
ROWS = 1 << 16


def alignment(pairs: DataFrame, key: list[str], words: bool = False, f_for_s: bool = False, errors: bool = False) -> DataFrame:
    """(*key, idx, op, guess, gold): one row for each step of the alignment.

    With ``errors`` only steps that aren't equal, and ``isolated``: true if the neighbours on both sides are equal (or none). Neighbours
    are looked at where the alignment is made, so equal steps don't leave the task.
    """
    texts = dealt(pairs, *key).select(*key, prepared(F.col("guess")).alias("_g"), prepared(F.col("gold")).alias("_h"))
    fields = [T.StructField("idx", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("op", "guess", "gold")]]
    schema = T.StructType([*texts.schema.fields[: len(key)], *fields, *([T.StructField("isolated", T.BooleanType())] if errors else [])])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess, gold = ([x or "" for x in batch.column(c).to_pylist()] for c in ("_g", "_h"))
            for own in _chunks(gold):
                cut = (cut_words if words else cut_characters)(guess[own], gold[own], f_for_s)
                steps = compared(cut, f_for_s, keep=True)[1]
                ops, sizes = _sized(steps)
                starts = np.cumsum(sizes) - sizes
                pair = np.repeat(np.arange(sizes.size), sizes)
                at = np.flatnonzero(ops != bands.EQUAL) if errors else np.arange(ops.size)
                op, own_pair = ops[at], pair[at]
                columns = [batch.column(k).take(pa.array(own_pair + own.start)) for k in range(len(key))]
                columns += [pa.array(at - starts[own_pair], pa.int32()), pa.array(["=", "S", "I", "D"]).take(pa.array(op))]
                for names, entries, missing in zip(cut.names, cut.entries, (bands.INSERTED, bands.DELETED), strict=True):
                    none = op == missing
                    place = np.where(none, 0, np.cumsum(ops != missing)[at] - 1)
                    columns.append(pa.array(names, pa.string()).take(pa.array(entries[place] if entries.size else place, mask=none)))
                if errors:
                    wrong = np.concatenate([[False], ops != bands.EQUAL, [False]])
                    first, last = at == starts[own_pair], at == starts[own_pair] + sizes[own_pair] - 1
                    columns.append(pa.array((first | ~wrong[at]) & (last | ~wrong[at + 2])))
                rows = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                yield from (rows.slice(k, ROWS) for k in range(0, rows.num_rows, ROWS))

    return texts.mapInArrow(run, schema)


def confusions(errors: DataFrame) -> DataFrame:
    """(op, guess, gold, isolated, n): errors of an ``alignment`` counted; isolated ones have equal neighbours on both sides."""
    return errors.groupBy("op", "guess", "gold", "isolated").agg(F.count(F.lit(1)).alias("n"))


def errors_by_length(words: DataFrame, cap: int = 10) -> DataFrame:
    """(length, total, wrong) of gold words, lengths over ``cap`` together."""
    length = F.least(F.length("gold"), F.lit(cap)).alias("length")
    return words.where("gold is not null").groupBy(length).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("op") != "=").alias("wrong"))


def confusion_distances(words: DataFrame, cap: int = 10) -> DataFrame:
    """(distance, n): edit distances of substituted words, capped."""
    return words.where("op = 'S'").groupBy(F.least(F.levenshtein("guess", "gold"), F.lit(cap)).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def top_missed_words(words: DataFrame, limit: int = 20) -> DataFrame:
    """The gold words missed most often; of equally many, first by name."""
    return words.where("op <> '=' and gold is not null").groupBy("gold").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold").limit(limit)


def error_sample(words: DataFrame, key: list[str], size: int = 50) -> DataFrame:
    """A fixed pseudo-random choice of word errors, in order of place; long s marks ``|`` become s."""
    drawn = words.where("op <> '='").orderBy(F.xxhash64(*key, "idx"), *key, "idx").limit(size)
    return drawn.select(*key, "idx", "op", F.replace("guess", F.lit("|"), F.lit("s")).alias("guess"), F.replace("gold", F.lit("|"), F.lit("s")).alias("gold")).orderBy(*key, "idx")


def ops_text(pairs: DataFrame, key: list[str], words: bool = False, f_for_s: bool = False) -> DataFrame:
    """(*key, ops): the alignment of each pair as a string of its steps."""

    @F.pandas_udf("string")
    def steps(guess: pd.Series, gold: pd.Series) -> pd.Series:
        a, b = guess.tolist(), gold.tolist()
        cuts = ((cut_words if words else cut_characters)(a[own], b[own], f_for_s) for own in _chunks(b))
        names = np.frombuffer(b"=SID", np.uint8)
        return pd.Series([names[own].tobytes().decode() for cut in cuts for own in compared(cut, f_for_s, keep=True)[1]], dtype=object)

    texts = dealt(pairs, *key).select(*key, *[F.coalesce(prepared(F.col(c)), F.lit("")).alias(c) for c in ("guess", "gold")])
    # A condition on the steps themselves would be tested below the exchange, in as many tasks as there are files, and make them twice.
    texts = texts if words else texts.where("guess <> '' or gold <> ''")
    return texts.select(*key, steps("guess", "gold").alias("ops"))
