"""Lines of decoded states as NumPy columns of an Arrow batch.

What a state writes is an entry of a small vocabulary. The text of a stretch of states is its entries end to end: the bytes of
all entries are laid out once, and fewer offsets cut them into stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphspark.functions import charset

#: States (or bytes of lines) that are taken at once, some 200 bytes of memory each; a longer line or document is taken alone.
CHUNK = 1 << 19
ELIDED = ["TILDE_ELIDED", "FIRST_ELIDED", "ELIDED"]


class Column(NamedTuple):
    """A string of every state: a vocabulary, and the place of each state's string in it."""

    words: list
    at: np.ndarray

    def where(self, test: Callable) -> np.ndarray:
        """States whose string (none for null) passes ``test``."""
        return np.array([bool(test(x)) for x in self.words], bool)[self.at]

    def isin(self, *words: str) -> np.ndarray:
        return self.where(lambda x: x in words)


def instead(column: Column, *cases: tuple[np.ndarray, str]) -> Column:
    """``column`` with another string in the states of a case; the first case that holds counts."""
    words, at = list(column.words), column.at
    for mask, text in reversed(cases):
        at = np.where(mask, len(words), at)
        words.append(text)
    return Column(words, at)


def joined(column: Column, cuts: np.ndarray) -> pa.Array:
    """Texts of the stretches between ``cuts`` (ascending, the first 0, the last the number of states); null writes nothing."""
    return _thinned(pa.array([x or "" for x in column.words], pa.large_string()).take(pa.array(column.at)), cuts)


def _thinned(texts: pa.Array, cuts: np.ndarray) -> pa.Array:
    """``texts`` (large strings without nulls) end to end, cut before each of ``cuts``."""
    if not len(texts):
        return pa.array([""] * (len(cuts) - 1), pa.large_string())
    texts = pa.concat_arrays([texts])
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)[cuts]
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), data)


def _cat(*parts) -> pa.Array:
    """Strings put together, row by row."""
    return pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts], pa.scalar("", pa.large_string()))


def _trimmed(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(texts, characters=" ")


def _digits(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64()).cast(pa.large_string())


def _below(cuts: np.ndarray) -> np.ndarray:
    """The stretch of every state."""
    return np.repeat(np.arange(cuts.size - 1), np.diff(cuts))


def _cuts(new: np.ndarray) -> np.ndarray:
    """Offsets of stretches that begin where ``new`` holds."""
    return np.append(np.flatnonzero(new), new.size)


class States:
    """States of a batch's lines: ``start`` are the n + 1 offsets of lines in them."""

    def __init__(self, start, type, lang, lm_char, glyph, glyph_type, char_w, pad_w) -> None:
        self.start, self.type, self.lang, self.lm_char, self.glyph, self.glyph_type, self.pad = start, type, lang, lm_char, glyph, glyph_type, pad_w
        self.width = char_w + pad_w
        self.n = self.width.size
        self.single = glyph_type.where(lambda x: x is not None and x != "DOUBLED")
        self.shown = glyph_type.where(lambda x: x is not None and x not in ELIDED)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> States:
        """Of packed lines (states), or of plain ones (lang, line_no, line), whose states follow by the rules of ``transcript.packed_fixture``."""
        if "line" in batch.schema.names:
            return cls(*_of_text(batch))
        lists = batch.column("states")
        start = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        rows = lists.flatten()
        field = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
        text = lambda name: _column(field[name])
        number = lambda name: field[name].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        return cls(start, text("type"), text("lang"), text("lm_char"), text("glyph"), text("glyph_type"), number("char_w"), number("pad_w"))


def _column(texts: pa.Array) -> Column:
    coded = texts.dictionary_encode(null_encoding="encode")
    return Column(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False))


def _of_text(batch: pa.RecordBatch) -> tuple:
    """States of plain lines; a row without a line has none."""
    own = batch.column("line").to_pylist()
    text = "".join([x for x in own if x])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    number = batch.column("line_no").to_numpy(zero_copy_only=False).astype(np.int64)
    is_line = np.array([x is not None for x in own], bool)
    size = np.array([len(x or "") for x in own], np.int64)
    left, right, hyphen = is_line & (number % 2 == 0), is_line & (number % 3 == 0), is_line & (number % 3 == 1)
    start = np.concatenate([[0], np.cumsum(size + left + right + hyphen)])
    line = _below(start)
    pos = (np.arange(int(start[-1])) - (start[:-1] - 1 + left)[line]).astype(np.int32)
    body = (pos > 0) & (pos <= size[line])
    code = np.full(pos.size, 32, np.uint32)
    code[body] = codes
    end = pos > 0
    end &= ~body
    hyphen = end & hyphen[line]
    code[hyphen] = ord("-")
    seen = np.zeros(int(code.max(initial=0)) + 1, bool)
    seen[code] = True
    known = np.flatnonzero(seen)
    rank = np.zeros(seen.size, np.int32)
    rank[known] = np.arange(known.size)
    chars = Column([chr(x) for x in known.tolist()], rank[code])
    of = lambda letters: body & chars.where(lambda x: x in letters)
    glyph = instead(chars, (of("s") & (pos % 7 == 0), "ſ"), (hyphen & (number % 2 != 0)[line], " "))
    letters = of(charset.LETTERS)
    kinds = ["NORMAL_CHAR", "ELISION_TILDE", "FIRST_ELIDED", "DOUBLED"]
    kind = np.where(of(charset.VOWELS) & (pos % 11 == 0), 1, np.where(letters & (pos % 13 == 0), 2, np.where(letters & (pos % 17 == 0), 3, 0)))
    types = ["TMPL", "LMRGN", "RMRGN", "RMRGN_HPHN_INIT"]
    langs = _column(batch.column("lang"))
    third = pos % 150
    margin = ~body & ~hyphen
    lang = instead(Column(langs.words, langs.at[line]), (margin, None), (body & (third >= 50) & (third < 100), "la"))
    wide = np.where(body, (known % 7 + 3)[chars.at], 5)
    return start, Column(types, np.where(body, 0, np.where(pos == 0, 1, np.where(hyphen, 3, 2)))), lang, chars, glyph, Column(kinds, kind), wide, np.where(body, pos % 3, 1).astype(np.int64)


# Batches


def _doc_changes(batch: pa.RecordBatch) -> np.ndarray:
    """Rows, but the first, whose document isn't that of the row before."""
    at = batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.diff(at)) + 1


def _parts(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch cut at some of ``ends`` into pieces of ``CHUNK`` at most, or of one stretch that is longer."""
    sizes = pc.binary_length(batch.column("line")) if "line" in batch.schema.names else pc.list_value_length(batch.column("states"))
    total = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    row = 0
    while row < batch.num_rows:
        later = ends[ends > row]
        to = int(later[max(int(np.searchsorted(total[later], total[row] + CHUNK, "right")) - 1, 0)])
        yield batch.slice(row, to - row)
        row = to


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _parts(batch, np.arange(1, batch.num_rows + 1))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of documents as batches of whole documents."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        if held:
            batch = pa.concat_batches(held)
            yield from _parts(batch, np.append(_doc_changes(batch), batch.num_rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column("doc_id")[-1].as_py() != batch.column("doc_id")[0].as_py():
            yield from whole()
            held = []
        changes = _doc_changes(batch)
        if changes.size:
            held.append(batch.slice(0, int(changes[-1])))
            yield from whole()
            batch = batch.slice(int(changes[-1]))
            held = []
        held.append(batch)
    yield from whole()


def written(lines: DataFrame, kernel: Callable, keys: list[str], schema: dict[str, T.DataType], documents: bool = False) -> DataFrame:
    """(*keys, columns of ``schema``) that ``kernel`` makes of pieces of ``lines``: (doc_id, line_no, states or lang and line).

    The kernel gives the row of the piece whose keys each of its rows has, and the columns. With ``documents``, which asks for rows
    in order, pieces are whole documents.
    """
    out = T.StructType([*[lines.schema[k] for k in keys], *[T.StructField(name, kind) for name, kind in schema.items()]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (_documents if documents else _lines)(batches):
            row, *made = kernel(part, States.of(part))
            row = pa.array(row)
            columns = [part.column(k).take(row) for k in keys] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return lines.mapInArrow(run, out)


# Words and spaces


class Spans(NamedTuple):
    """Words and stretches of space: line, number in it from 1, whether space, language, width, texts."""

    line: np.ndarray
    number: np.ndarray
    space: np.ndarray
    lang: pa.Array
    width: np.ndarray
    diplomatic: pa.Array
    normalized: pa.Array


def spans(states: States, escaped: bool = False) -> Spans:
    """Spans of all lines, in order; a punctuation mark starts one. Texts are escaped for XML if asked for."""
    s = states
    line = _below(s.start)
    space = s.lm_char.isin(" ") & s.glyph.isin(" ")
    marks = pc.match_substring_regex(pa.array([x or "" for x in s.lm_char.words], pa.string()), r"\A[^\s\p{L}\p{N}]+\z").to_pylist()
    new = np.array([m and x != "-" for m, x in zip(marks, s.lm_char.words, strict=True)], bool)[s.lm_char.at]
    new[1:] |= (space[1:] != space[:-1]) | (line[1:] != line[:-1])
    new[:1] = True
    cuts = _cuts(new)
    first = cuts[:-1]
    own = line[first]
    number = np.arange(first.size) - np.searchsorted(own, own) + 1
    dipl = instead(s.glyph, (~s.shown, ""))
    margin, hyphen, init = s.type.isin("LMRGN", "RMRGN"), s.type.isin("RMRGN_HPHN", "LMRGN_HPHN"), s.type.isin("RMRGN_HPHN_INIT")
    norm = instead(s.lm_char, (~s.single, ""), (init, "-"), (hyphen, ""), (margin, " "))
    text = lambda column: _trimmed(joined(column, cuts))
    if escaped:
        text = lambda column: _letters(_trimmed(joined(Column([_entities(x or "") for x in column.words], column.at), cuts)), column)
    langs = pa.array(["None" if x is None else x for x in s.lang.words], pa.large_string())
    width = np.add.reduceat(s.width, first) if first.size else np.zeros(0, np.int64)
    return Spans(own, number, space[first], langs.take(pa.array(s.lang.at[first])), width, text(dipl), text(norm))


def _entities(x: str) -> str:
    for a, b in charset.ENTITIES:
        x = x.replace(a, b)
    return x


def _letters(texts: pa.Array, column: Column) -> pa.Array:
    """Entities of letters with a tilde, whose mark may be a state of its own."""
    if any("̃" in (x or "") for x in column.words):
        for a, b in charset.LETTER_ENTITIES:
            texts = pc.replace_substring(texts, a, b)
    return texts


def span_rows(batch: pa.RecordBatch, states: States) -> tuple:
    x = spans(states)
    return x.line, x.number, x.space, x.lang, x.width, x.diplomatic, x.normalized


def _items(batch: pa.RecordBatch, states: States, normalized: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Lines, span numbers, word indices (null for space) and ALTO elements of whole documents."""
    x = spans(states, escaped=True)
    own, other, purpose = (x.normalized, x.diplomatic, "Diplomatic") if normalized else (x.diplomatic, x.normalized, "Normalization")
    word = ~x.space & (pc.binary_length(x.diplomatic).to_numpy(zero_copy_only=False) > 0)
    words = np.concatenate([[0], np.cumsum(word)])  # words before a span
    at_line = np.searchsorted(x.line, np.arange(batch.num_rows))
    at_doc = at_line[np.concatenate([[0], _doc_changes(batch)])] if batch.num_rows else at_line
    doc = np.zeros(batch.num_rows, np.int64)
    doc[_doc_changes(batch)] = 1
    before = words[:-1]
    kept = np.flatnonzero(word | (x.space & (x.width > 0) & (before > words[at_line[x.line]])))
    index = before - words[at_doc[np.cumsum(doc)[x.line]]]
    is_word = word[kept]
    k = kept[is_word]
    take = lambda a: a.take(pa.array(k))
    own, other = take(own), take(other)
    more = pc.if_else(pc.not_equal(own, other), _cat(f'><ALTERNATIVE PURPOSE="{purpose}">', other, "</ALTERNATIVE></String>"), pa.scalar("/>", pa.large_string()))
    text = _cat('<String ID="word_', _digits(index[k]), '" WIDTH="', _digits(x.width[k]), '" CONTENT="', own, '" LANG="', take(x.lang), '"', more)
    blank = _cat('<SP WIDTH="', _digits(x.width[kept[~is_word]]), '"/>')
    place = np.where(is_word, np.cumsum(is_word) - 1, k.size + np.cumsum(~is_word) - 1)
    xml = pa.concat_arrays([text, blank]).take(pa.array(place))
    return x.line[kept], x.number[kept], pa.array(index[kept], pa.int64(), mask=~is_word), xml


def alto_rows(normalized: bool) -> Callable:
    return lambda batch, states: _items(batch, states, normalized)


def alto_bodies(normalized: bool) -> Callable:
    """Lines of a page's words, end to end; pages without words have no row."""

    def kernel(batch: pa.RecordBatch, states: States) -> tuple:
        line, _, _, xml = _items(batch, states, normalized)
        new = np.ones(line.size, bool)
        new[1:] = line[1:] != line[:-1]
        cuts = _cuts(new)
        own = line[cuts[:-1]]
        number = batch.column("line_no").to_numpy(zero_copy_only=False).astype(np.int64)[own]
        texts = _cat('<TextLine ID="line_', _digits(number + 1), '">', _thinned(xml, cuts), "</TextLine>\n")
        doc = np.searchsorted(_doc_changes(batch), own, "right")
        new = np.ones(doc.size, bool)
        new[1:] = doc[1:] != doc[:-1]
        cuts = _cuts(new)
        return own[cuts[:-1]], _thinned(texts, cuts)

    return kernel


# Languages, white space, comparisons


def run_rows(batch: pa.RecordBatch, states: States) -> tuple:
    """Rows, numbers, languages and texts of stretches in one language."""
    s = states
    kept = np.flatnonzero(s.type.isin("TMPL") & s.lang.where(lambda x: x is not None) & s.single)
    line = _below(s.start)[kept]
    doc = np.searchsorted(_doc_changes(batch), line, "right")
    codes: dict = {}
    lang = np.array([codes.setdefault(x, len(codes)) for x in s.lang.words], np.int64)[s.lang.at[kept]]  # equal strings may be several entries
    new = np.ones(kept.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])
    cuts = _cuts(new)
    first = cuts[:-1]
    number = np.arange(first.size) - np.searchsorted(doc[first], doc[first]) + 1
    langs = pa.array(s.lang.words, pa.large_string()).take(pa.array(s.lang.at[kept[first]]))
    return line[first], number, langs, joined(Column(s.lm_char.words, s.lm_char.at[kept]), cuts)


def layout_rows(batch: pa.RecordBatch, states: States) -> tuple:
    """Lines with the widths of space and padding in braces."""
    s = states
    solid = s.glyph.where(lambda x: x is not None and x != " ")
    # places of glyphs and of the ends of lines, in order; space before a place: padding of the glyph before it, and all space states in between
    lines = np.arange(batch.num_rows)
    at = np.flatnonzero(solid)
    count = np.bincount(_below(s.start)[at], minlength=lines.size)
    ends = np.cumsum(count + 1)
    place = np.empty(at.size + lines.size, np.int64)
    is_end = np.zeros(place.size, bool)
    is_end[ends - 1] = True
    place[is_end], place[~is_end] = s.start[1:], at
    blank = np.concatenate([[0], np.cumsum(np.where(solid, 0, s.width))])
    begin = np.zeros(place.size, bool)
    begin[ends - count - 1] = True
    before = np.empty(place.size, np.int64)
    before[1:] = place[:-1]
    before[begin] = s.start[:-1]
    pad = np.zeros(place.size, np.int64)
    pad[~begin] = s.pad[before[~begin]]
    width = np.maximum(blank[place] - blank[before] + pad, 0)
    seen = np.unique(width)
    glyphs = [x or "" for x in s.glyph.words]
    words = ["", *glyphs, *[f"{{{x}}}" if x else "" for x in seen.tolist()]]
    pieces = np.zeros(2 * place.size, np.int64)
    pieces[::2] = np.searchsorted(seen, width) + 1 + len(glyphs)
    pieces[1::2][~is_end] = s.glyph.at[at] + 1
    return lines, joined(Column(words, pieces), np.concatenate([[0], 2 * ends]))


def substituted(states: States) -> Column:
    """What ``transcript.substitution`` writes for every state: each different one is an entry."""
    s = states
    key = (s.lm_char.at.astype(np.int64) * len(s.glyph.words) + s.glyph.at) * len(s.glyph_type.words) + s.glyph_type.at
    seen, at = _distinct(key, len(s.lm_char.words) * len(s.glyph.words) * len(s.glyph_type.words))
    words = []
    for k in seen.tolist():
        k, kind = divmod(k, len(s.glyph_type.words))
        char, glyph = s.lm_char.words[k // len(s.glyph.words)], s.glyph.words[k % len(s.glyph.words)]
        kind = s.glyph_type.words[kind]
        if char == glyph and kind == "NORMAL_CHAR":
            words.append(glyph)
        elif char is None or (glyph is None and kind not in ELIDED):
            words.append(None)
        else:
            words.append(f"[{char}/{'2x' + glyph if kind == 'DOUBLED' else '' if kind in ELIDED else glyph}]")
    return Column(words, at)


def _distinct(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``most`` and the place of each key in them."""
    if most > 1 << 22:
        return np.unique(key, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[key] = True
    known = np.flatnonzero(seen)
    rank = np.zeros(most, np.int64)
    rank[known] = np.arange(known.size)
    return known, rank[key]


def _diplomatic(states: States, line: np.ndarray) -> Column:
    """Glyphs as shown; a second hyphen in a row is dropped."""
    s = states
    kept = np.flatnonzero(s.shown)
    hyphen = s.glyph.isin("-")[kept]
    again = np.zeros(kept.size, bool)
    again[1:] = hyphen[1:] & hyphen[:-1] & (line[kept][1:] == line[kept][:-1])
    drop = ~s.shown
    drop[kept[again]] = True
    return instead(s.glyph, (drop, ""))


def _any(states: States, mask: np.ndarray) -> np.ndarray:
    """Lines with a state of ``mask``."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[states.start[1:]] > total[states.start[:-1]]


def _largest(texts: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """The largest text that isn't null of every group of rows, which are in order."""
    some = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    place = np.full(n, -1, np.int64)
    place[group[some]] = some
    if some.size > 1 and (group[some][1:] == group[some][:-1]).any():
        at = texts.cast(pa.large_binary())
        for k in some.tolist():
            if at[k].as_py() > at[int(place[group[k]])].as_py():
                place[group[k]] = k
    return texts.take(pa.array(place, mask=place < 0))


def report_rows(titles: dict[str, str]) -> Callable:
    """Reports of whole documents (rows of their own lines, and rows of gold ones with a text ``gold``); ``titles`` of sides MN, MD, GD, MS, in order."""

    def kernel(batch: pa.RecordBatch, states: States) -> tuple:
        s = states
        line = _below(s.start)
        own = batch.column("line" if "line" in batch.schema.names else "states").is_valid().to_numpy(zero_copy_only=False)
        runs_on = s.single & ~s.type.isin("RMRGN_HPHN_INIT", "RMRGN_HPHN", "LMRGN_HPHN")
        where = lambda mask, texts: pc.if_else(pa.array(mask), texts, pa.scalar(None, pa.large_string()))
        sides = {
            "MN": where(_any(s, s.single), joined(instead(s.lm_char, (~s.single, "")), s.start)),
            "MD": where(_any(s, s.shown), joined(_diplomatic(s, line), s.start)),
            "GD": batch.column("gold").cast(pa.large_string()),
            "MS": where(own, joined(substituted(s), s.start)),
        }
        # rows of the same line of a document are one line of the report
        doc = np.searchsorted(_doc_changes(batch), np.arange(batch.num_rows), "right")
        number = batch.column("line_no").to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.ones(batch.num_rows, bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        group, n = np.cumsum(new) - 1, int(new.sum())
        doc = doc[new]
        at = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [n]])
        block, head = [], []
        for side in titles:
            texts = _largest(_trimmed(sides[side]), group, n)
            given = np.add.reduceat(texts.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), at[:-1]) > 0
            if given.any():
                shown = lambda mask, x: pc.if_else(pa.array(mask), x, pa.scalar("", pa.large_string()))
                block.append(shown(given[doc], _cat(f"{side}: ", texts.fill_null(""), "\n")))
                head.append(shown(given, pa.array([f"{side}: {titles[side]}\n"] * given.size, pa.large_string())))
        body = _thinned(_cat(*block, "\n"), at)
        running = where(_any(s, runs_on), joined(instead(s.lm_char, (~runs_on, ""), (s.type.isin("LMRGN", "RMRGN"), " ")), s.start))
        running = _largest(running, group, n)
        runs = np.add.reduceat(running.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), at[:-1]) > 0
        running = _trimmed(pc.replace_substring_regex(_thinned(running.fill_null(""), at), " +", " "))
        text = pc.if_else(pa.array(runs), _cat("Model normalized transcription\n", running, "\n"), pa.scalar("", pa.large_string()))
        first = np.flatnonzero(new)[at[:-1]]
        return first, _cat(*head, "\n\n", body, "\n", text, "\n")

    return kernel
