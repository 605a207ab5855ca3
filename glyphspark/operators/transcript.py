"""From decoded states to transcriptions: array functions and NumPy kernels (``states``) over lines, aggregates and windows over documents.

decode(doc_id, line_no, pos, type, lang, lm_char, glyph, glyph_type, char_w, pad_w), or its lines as ``packed`` gives them. What goes
by ``states`` also takes plain lines (doc_id, line_no, lang, line), whose states it makes in the task as ``packed_fixture`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphspark.functions import charset
from glyphspark.operators import states as kernels
from glyphspark.operators.shared import dealt
from glyphspark.operators.states import ELIDED

HYPHEN_MARGINS = ["RMRGN_HPHN_INIT", "RMRGN_HPHN", "LMRGN_HPHN"]
COLORS = ["Black", "Red", "Blue", "Olive", "Orange", "Magenta", "Lime", "Cyan", "Purple", "Green", "Brown"]  # fixed values


def in_order(out: Column, *order: str) -> Column:
    """Aggregate: strings joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, out.alias("_out")))), lambda s: s["_out"]), "")


def packed(decode: DataFrame) -> DataFrame:
    """(doc_id, line_no, states): a row a line with its states in order, so that lines are never taken apart over the network.

    Lines that are packed stay as they are; states are gathered in one exchange.
    """
    if "states" in decode.columns:
        return decode
    fields = [c for c in decode.columns if c not in ("doc_id", "line_no", "pos")]
    return decode.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("states"))


def _plain(decode: DataFrame) -> DataFrame:
    """Lines for ``states``."""
    return decode.select("doc_id", "line_no", "lang", "line") if "line" in decode.columns else packed(decode)


def _in_documents(decode: DataFrame) -> DataFrame:
    """The same, lines of a document together and in order."""
    return _plain(dealt(decode, "doc_id")).sortWithinPartitions("doc_id", "line_no")


def once(column: Column, name: str) -> Column:
    """``column`` as a row of its own: filters and projections after it don't compute it again."""
    return F.inline(F.array(F.struct(column.alias(name))))


def _joined(states: Column, out) -> Column:
    return F.array_join(F.transform(states, out), "")


def _shown(s: Column) -> Column:
    return ~s["glyph_type"].isin(ELIDED)


def _diplomatic(shown: Column) -> Column:
    """Text of a line's states without elided ones."""
    kept = F.filter(shown, lambda s, i: (s["glyph"] != "-") | ~F.coalesce(F.get(shown, i - 1)["glyph"] == "-", F.lit(False)))
    return _joined(kept, lambda s: s["glyph"])


def diplomatic_lines(decode: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): glyphs as shown; elided ones show nothing, and a second hyphen in a row is dropped."""
    lines = packed(decode).select("doc_id", "line_no", once(F.filter("states", _shown), "_shown"))
    return lines.where(F.size("_shown") > 0).select("doc_id", "line_no", _diplomatic(F.col("_shown")).alias("text"))


def _single(s: Column) -> Column:
    return s["glyph_type"] != "DOUBLED"


def normalized_lines(decode: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): characters of the language; the first of a doubled pair is left out."""
    lines = packed(decode).where(F.exists("states", _single))
    return lines.select("doc_id", "line_no", _joined(F.filter("states", _single), lambda s: s["lm_char"]).alias("text"))


def _runs_on(s: Column) -> Column:
    return ~s["type"].isin(HYPHEN_MARGINS) & _single(s)


def _running_line(states: Column) -> Column:
    return _joined(F.filter(states, _runs_on), lambda s: F.when(s["type"].isin("LMRGN", "RMRGN"), F.lit(" ")).otherwise(s["lm_char"]))


def _running(line: str) -> Column:
    """Aggregate: lines of a document as one text."""
    return F.trim(F.regexp_replace(in_order(F.col(line), "line_no"), " +", " "))


def normalized_running(decode: DataFrame) -> DataFrame:
    """(doc_id, text): one running text a document: margins are spaces, hyphenated line ends join, spaces collapse."""
    lines = packed(decode).where(F.exists("states", _runs_on))
    return lines.select("doc_id", "line_no", _running_line(F.col("states")).alias("_line")).groupBy("doc_id").agg(_running("_line").alias("text"))


def language_runs(decode: DataFrame) -> DataFrame:
    """(doc_id, run, lang, text): stretches of a document in one language; states without one don't break a stretch."""
    return kernels.written(_in_documents(decode), kernels.run_rows, ["doc_id"], {"run": T.LongType(), "lang": T.StringType(), "text": T.StringType()}, documents=True)


def word_spans(decode: DataFrame) -> DataFrame:
    """(doc_id, line_no, span, is_space, lang, width, diplomatic, normalized) of every word and stretch of space; a punctuation mark starts a span."""
    text = T.StringType()
    schema = {"span": T.LongType(), "is_space": T.BooleanType(), "lang": text, "width": T.LongType(), "diplomatic": text, "normalized": text}
    return kernels.written(_plain(decode), kernels.span_rows, ["doc_id", "line_no"], schema)


def alto_items(decode: DataFrame, normalized: bool = False) -> DataFrame:
    """(doc_id, line_no, span, word_index, xml): ALTO elements of words, numbered through a document, and of the spaces between them."""
    schema = {"span": T.LongType(), "word_index": T.LongType(), "xml": T.StringType()}
    return kernels.written(_in_documents(decode), kernels.alto_rows(normalized), ["doc_id", "line_no"], schema, documents=True)


def alto_pages(decode: DataFrame, normalized: bool = False) -> DataFrame:
    """(doc_id, xml): the ALTO document of every page."""
    pages = kernels.written(_in_documents(decode), kernels.alto_bodies(normalized), ["doc_id"], {"_body": T.StringType()}, documents=True)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Description><MeasurementUnit>pixel</MeasurementUnit></Description><Layout><Page ID="'
    return pages.select("doc_id", F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit('"><PrintSpace><TextBlock ID="par_1">\n'), F.col("_body"), F.lit("</TextBlock></PrintSpace></Page></Layout></alto>\n")).alias("xml"))


def substitution(s: Column) -> Column:
    """A state as it is read: the glyph, or ``[character/glyph]`` where they differ; doubled ones as 2x, elided ones as nothing."""
    dipl = F.when(s["glyph_type"] == "DOUBLED", F.concat(F.lit("2x"), s["glyph"])).when(s["glyph_type"].isin(ELIDED), F.lit("")).otherwise(s["glyph"])
    plain = (s["lm_char"] == s["glyph"]) & (s["glyph_type"] == "NORMAL_CHAR")
    return F.when(plain, s["glyph"]).otherwise(F.concat(F.lit("["), s["lm_char"], F.lit("/"), dipl, F.lit("]")))


def substitution_lines(decode: DataFrame) -> DataFrame:
    return packed(decode).select("doc_id", "line_no", _joined(F.col("states"), substitution).alias("text"))


def html_lines(decode: DataFrame, languages: list[str]) -> DataFrame:
    """(doc_id, line_no, html): lines with a colour change wherever the language changes, across lines too."""

    def turn(before: Column, lang: Column) -> Column:
        color = F.lit(COLORS[0])
        for k, name in enumerate(languages):
            color = F.when(lang == name, F.lit(COLORS[(k + 1) % len(COLORS)])).otherwise(color)
        return F.when(~before.eqNullSafe(lang), F.concat(F.lit('<font color="'), color, F.lit('">'))).otherwise(F.lit(""))

    # what stands before a line is the last language of the line before; the line itself goes as one text
    lang = lambda s: F.coalesce(s["lang"], F.lit(""))
    inner = F.transform("states", lambda s, i: F.concat(F.when(i == 0, F.lit("")).otherwise(turn(lang(F.get("states", i - 1)), lang(s))), substitution(s)))
    lines = packed(decode).select("doc_id", "line_no", F.array_join(inner, "").alias("_text"), lang(F.get("states", 0)).alias("_first"), lang(F.element_at("states", -1)).alias("_last"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy("doc_id").orderBy("line_no")), F.lit(""))
    lines = lines.withColumn("_before", before)
    return lines.select("doc_id", "line_no", F.concat(turn(F.col("_before"), F.col("_first")), F.col("_text"), F.lit("</br>")).alias("html"))


def whitespace_layout(decode: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): glyphs with the widths of space and padding between them in braces."""
    return kernels.written(_plain(decode), kernels.layout_rows, ["doc_id", "line_no"], {"text": T.StringType()})


def pair_lines(model: DataFrame, gold: DataFrame) -> DataFrame:
    """Model and gold lines side by side; where one side has no line its text is empty."""
    m, g = model.select("doc_id", "line_no", F.col("text").alias("model")), gold.select("doc_id", "line_no", F.col("text").alias("gold"))
    return m.join(g, ["doc_id", "line_no"], "full_outer").select("doc_id", "line_no", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("gold", F.lit("")).alias("gold"))


# The sides of a comparison, in order.
SIDES = {"MN": "Model normalized transcription", "GN": "Gold normalized transcription", "MD": "Model diplomatic transcription", "GD": "Gold diplomatic transcription", "MS": "Model transcription with substitutions"}


def comparison(model: DataFrame, gold: DataFrame | None = None, normalized: DataFrame | None = None, gold_normalized: DataFrame | None = None, substituted: DataFrame | None = None, running: DataFrame | None = None, gold_running: DataFrame | None = None, evaluations: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): all sides of a transcription under each other, line by line, then as running texts, then the scores.

    Sides are lines (doc_id, line_no, text), running texts (doc_id, text), scores (doc_id, side, metric, score) of the sides
    ``diplomatic`` and ``normalized``. A side that isn't given, or that a document lacks, isn't shown; a side's missing lines
    are empty.
    """
    frames = {"MN": normalized, "GN": gold_normalized, "MD": model, "GD": gold, "MS": substituted}
    rows = None
    for side, df in frames.items():
        if df is not None:
            own = df.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.lit(side).alias("side"), F.trim("text").alias("text"))
            rows = own if rows is None else rows.unionByName(own)
    sides = [s for s, df in frames.items() if df is not None]
    by_line = dealt(rows, "doc_id").groupBy("doc_id", "line_no").agg(*[F.max(F.when(F.col("side") == s, F.col("text"))).alias(s) for s in sides])
    return _reported(by_line.withColumn("_line", F.lit(None).cast("string")), sides, running, gold_running, evaluations)


def decoded_comparison(decode: DataFrame, gold: DataFrame) -> DataFrame:
    """``comparison`` of a decode table's own sides and running text with gold lines; both are dealt once, as they come."""
    lines = _plain(decode)
    gold = gold.select("doc_id", F.col("line_no").cast(lines.schema["line_no"].dataType).alias("line_no"), F.col("text").alias("gold"))
    rows = dealt(lines.unionByName(gold, allowMissingColumns=True), "doc_id").sortWithinPartitions("doc_id", "line_no")
    titles = {s: SIDES[s] for s in ("MN", "MD", "GD", "MS")}
    return kernels.written(rows, kernels.report_rows(titles), ["doc_id"], {"report": T.StringType()}, documents=True)


def _reported(by_line: DataFrame, sides: list[str], running: DataFrame | None = None, gold_running: DataFrame | None = None, evaluations: DataFrame | None = None) -> DataFrame:
    """Reports from lines (doc_id, line_no, a column a side, _line: what the line adds to the running text, if that isn't given)."""
    w = Window.partitionBy("doc_id")
    by_line = by_line.withColumns({f"_{s}": F.max(F.col(s).isNotNull()).over(w) for s in sides})
    shown = lambda s, x: F.when(F.col(f"_{s}"), x).otherwise(F.lit(""))
    block = F.concat(*[shown(s, F.concat(F.lit(f"{s}: "), F.coalesce(s, F.lit("")), F.lit("\n"))) for s in sides], F.lit("\n"))
    head = F.concat(*[shown(s, F.lit(f"{s}: {SIDES[s]}\n")) for s in sides], F.lit("\n\n"))
    out = by_line.withColumns({"_block": block, "_head": head}).groupBy("doc_id").agg(F.first("_head").alias("_head"), in_order(F.col("_block"), "line_no").alias("_body"), F.when(F.max(F.col("_line").isNotNull()), _running("_line")).alias("_running"))
    none = F.lit(None).cast("string")
    for name, df in (("_running", running), ("_gold", gold_running)):
        if df is not None:
            out = out.drop(name).join(df.select("doc_id", F.col("text").alias(name)), "doc_id", "left")
        elif name not in out.columns:
            out = out.withColumn(name, none)
    both = F.col("_running").isNotNull() & F.col("_gold").isNotNull()
    title = F.when(both, "Model (top) vs. Gold (bottom) normalized transcriptions\n").when(F.col("_running").isNotNull(), "Model normalized transcription\n").when(F.col("_gold").isNotNull(), "Gold normalized transcription\n").otherwise("")
    line = lambda c: F.coalesce(F.concat(c, F.lit("\n")), F.lit(""))
    report = [F.col("_head"), F.col("_body"), F.lit("\n"), title, line(F.col("_running")), line(F.col("_gold")), F.lit("\n")]
    for side in ("diplomatic", "normalized") if evaluations is not None else ():
        own = evaluations.where(F.col("side") == side).groupBy("doc_id").agg(in_order(F.concat("metric", F.lit(": "), F.col("score").cast("string"), F.lit("\n")), "metric").alias(f"_{side}"))
        out = out.join(own, "doc_id", "left")
        report.append(F.coalesce(F.concat(F.lit(f"\n{side.capitalize()} evaluation\n"), f"_{side}"), F.lit("")))
    return out.select("doc_id", F.concat(*report).alias("report"))


def _fixture_state(pos: Column, c: Column, own: Column) -> Column:
    letters, vowels = c.isin(list(charset.LETTERS)), c.isin(list(charset.VOWELS))
    kind = F.when((pos % 11 == 0) & vowels, "ELISION_TILDE").when((pos % 13 == 0) & letters, "FIRST_ELIDED").when((pos % 17 == 0) & letters, "DOUBLED").otherwise("NORMAL_CHAR")
    glyph = F.when((pos % 7 == 0) & (c == "s"), "ſ").otherwise(c)
    lang = F.when((pos % 150 >= 50) & (pos % 150 < 100), F.lit("la")).otherwise(own)
    return F.struct(pos.alias("pos"), F.lit("TMPL").alias("type"), lang.alias("lang"), c.alias("lm_char"), glyph.alias("glyph"), kind.alias("glyph_type"), (F.ascii(c) % 7 + 3).cast("int").alias("char_w"), (pos % 3).cast("int").alias("pad_w"))


def packed_fixture(lines: DataFrame) -> DataFrame:
    """A packed decode table from lines of text, by fixed rules, for tests and queries where no pages were decoded."""

    def margin(where: str, pos: Column, kind: str, char: str, glyph: Column, lang: Column) -> Column:
        state = F.struct(pos.alias("pos"), F.lit(kind).alias("type"), lang.alias("lang"), F.lit(char).alias("lm_char"), glyph.alias("glyph"), F.lit("NORMAL_CHAR").alias("glyph_type"), F.lit(5).alias("char_w"), F.lit(1).alias("pad_w"))
        return F.filter(F.array(state), lambda _: F.expr(where))

    none, space = F.lit(None).cast("string"), F.lit(" ")
    end = F.length("line") + 1
    left = margin("line_no % 2 = 0", F.lit(0), "LMRGN", " ", space, none)
    right = margin("line_no % 3 = 0", end, "RMRGN", " ", space, none)
    hyphen = margin("line_no % 3 = 1", end, "RMRGN_HPHN_INIT", "-", F.when(F.col("line_no") % 2 == 0, "-").otherwise(" "), F.col("lang"))
    body = F.transform(F.split("line", ""), lambda c, k: _fixture_state(k + 1, c, F.col("lang")))
    return lines.select("doc_id", "line_no", once(F.concat(left, body, right, hyphen), "states"))


def decode_fixture(lines: DataFrame) -> DataFrame:
    """The same, a row a state."""
    return packed_fixture(lines).select("doc_id", "line_no", F.inline("states"))
