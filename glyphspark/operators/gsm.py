"""Glyph substitution: how often a character of the language is shown by a glyph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphspark.functions import charset

SPECIAL = ["ELISION_TILDE", "TILDE_ELIDED", "FIRST_ELIDED", "DOUBLED", "ELIDED"]


def glyph_counts(decode: DataFrame) -> DataFrame:
    """(lang, lm_char, glyph, n) of decoded states: templates with a language, and line-end hyphens that were left out.

    A glyph of a special type counts under the type's name.
    """
    shown = decode.where("(type = 'TMPL' and lang is not null) or (type = 'RMRGN_HPHN_INIT' and glyph = ' ' and lang is not null)")
    glyph = F.when(F.col("glyph_type") == "NORMAL_CHAR", F.col("glyph")).otherwise(F.col("glyph_type"))
    char = F.when(F.col("type") == "RMRGN_HPHN_INIT", F.lit("-")).otherwise(F.col("lm_char"))
    return shown.groupBy("lang", char.alias("lm_char"), glyph.alias("glyph")).agg(F.count(F.lit(1)).alias("n"))


def smoothing_grid(active: DataFrame, count: float = 1.0, elision: float = 100.0) -> DataFrame:
    """(lang, lm_char, glyph, k): smoothing counts over zero for all characters of a language and all glyphs of any.

    Characters (lang, char) are a small dimension; the grid has languages x characters x glyphs rows.
    """
    chars = active.select("char").distinct().union(active.sparkSession.createDataFrame([("ſ",), ("-",), (" ",)], "char string")).distinct()
    glyphs = chars.select(F.col("char").alias("glyph")).union(active.sparkSession.createDataFrame([(g,) for g in SPECIAL], "glyph string"))
    lm = active.select("lang", F.col("char").alias("lm_char")).union(active.select("lang").distinct().select("lang", F.lit("-"))).distinct()
    shown = active.select(F.col("lang"), F.col("char").alias("glyph"), F.lit(True).alias("own"))
    grid = lm.crossJoin(F.broadcast(glyphs)).join(F.broadcast(shown), ["lang", "glyph"], "left")  # characters of languages: thousands
    letter = F.col("lm_char").isin(list(charset.LETTERS))
    dropped = {c: charset.accent_dropped(c) for c in charset.DECOMPOSED if charset.accent_dropped(c)}
    bare = F.translate("lm_char", "".join(dropped), "".join(dropped.values()))
    accented = F.col("lm_char").isin(list(dropped))
    k, much = F.lit(float(count)), F.lit(float(count * elision))
    value = (
        F.when(F.col("glyph") == "ELISION_TILDE", F.when(letter | accented, much))
        .when(F.col("glyph").isin("TILDE_ELIDED", "FIRST_ELIDED"), F.when(letter, much))
        .when(F.col("glyph").isin("DOUBLED", "ELIDED"), F.when(letter, k))
        .when(accented & (F.col("glyph") == bare), much)
        .when((F.col("lm_char") == "s") & (F.col("glyph") == "ſ"), k)
        .when((F.col("lm_char") == "s") & F.col("glyph").isin("f", "l"), F.lit(None))
        .when((F.col("lm_char") == "-") & (F.col("glyph") == " "), k)
        .when(F.col("lm_char").isin(list(charset.REPLACEABLE)) & F.col("glyph").isin(list(charset.LETTERS)) & F.col("own"), k)
        .when(F.col("lm_char") == F.col("glyph"), k)
    )
    return grid.select("lang", "lm_char", "glyph", value.alias("k")).where("k > 0")


def smoothed(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """(lang, lm_char, glyph, c): counts and smoothing added up."""
    return counts.select("lang", "lm_char", "glyph", F.col("n").cast("double").alias("c")).union(grid.select("lang", "lm_char", "glyph", "k")).groupBy("lang", "lm_char", "glyph").agg(F.sum("c").alias("c"))


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, lm_char, glyph, p) from (.., c): shares by language and character; counts of nearly nothing are nothing."""
    total = F.sum("c").over(Window.partitionBy("lang", "lm_char"))
    return counts.select("lang", "lm_char", "glyph", F.when(F.col("c") > 1e-9, F.col("c") / total).otherwise(F.lit(0.0)).alias("p"))


def evaluation_probabilities(counts: DataFrame, grid: DataFrame, min_counts: float) -> DataFrame:
    """Shares of the counts without smoothing, of those of ``min_counts`` at least; below 1, all as they are."""
    if min_counts < 1:
        return probabilities(smoothed(counts, grid))
    return probabilities(counts.where(F.col("n") >= min_counts).select("lang", "lm_char", "glyph", F.col("n").cast("double").alias("c")))


def glyph_score(p, identity, power: float = 4.0, no_sub: float = 0.9):
    """Score of a glyph: the powered share, mixed with a prior of ``no_sub`` for showing the character itself."""
    return F.log((1 - no_sub) * F.pow(p, F.lit(power)) + F.when(identity, F.lit(no_sub)).otherwise(F.lit(0.0)))
