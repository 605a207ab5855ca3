"""The programs of the engine as functions: text to language model, models to fonts and glyph substitution, pages to lines to transcriptions.

Models are folders of Parquet tables (see ``sources.corpus``); a program checks its options, reads, computes and writes.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.functions import readers
from glyphspark.operators import decoder, evaluate, gsm, lm, lm_store, ngrams, pages, training, transcript, versions
from glyphspark.sources import corpus


def timed(program: Callable, *args: Any, **options: Any) -> tuple[Any, float]:
    """Run a program; its result and the seconds it took."""
    start = time.perf_counter()
    return program(*args, **options), time.perf_counter() - start


# Language models


def language_options(texts: str, priors: str = "", orders: str = "", rules: str = "", **more: Any) -> corpus.LanguageModelOptions:
    """Options from specifications ``lang->value,lang->value``; a single order counts for all languages."""
    paths = corpus.parse_languages(texts)
    if orders and "->" not in orders:
        more["order"], orders = int(orders), ""
    return corpus.LanguageModelOptions(paths, {k: float(v) for k, v in corpus.parse_languages(priors).items()}, {k: int(v) for k, v in corpus.parse_languages(orders).items()}, corpus.parse_languages(rules), **more)


def initialize_language_model(spark: SparkSession, options: corpus.LanguageModelOptions, path: str) -> None:
    """Count the characters of each language's texts and write counts, active characters, and priors to ``path``.

    N-grams don't cross files' lines when all characters are taken, nor files when they are limited to ``lm_char_count``.
    """
    lm.check_priors(options.priors or dict.fromkeys(options.texts, 1.0), options.keep_language)
    counted, seen = [], []
    for lang, place in options.texts.items():
        files = corpus.read_texts(spark, place).withColumn("lang", F.lit(lang))
        files = corpus.take_chars(files, options.lm_char_count)
        lines = ngrams.lines_of(files.withColumn("doc_id", F.xxhash64("path")))
        reader = readers.Reader(allowed=options.explicit_chars, remove_diacritics=options.remove_diacritics, long_s=options.insert_long_s, escapes=options.escapes)
        lines = lines.withColumn("line", readers.read(F.col("line"), reader)).where("line <> ''")
        if lang in options.rules:
            lines = readers.replace_some(lines, corpus.read_rules(spark, options.rules[lang]))
        lines = lines.withColumn("line", F.concat("line", F.lit(" ")))  # a line's end is a space
        own = ngrams.token_counts(lines, options.orders.get(lang, options.order))
        counted.append(own)
        seen.append(ngrams.active_chars(own.where("n = 1").select("lang", F.col("g").alias("char"), F.col("t").alias("n")), options.min_char_count))
    tok, active = counted[0], seen[0]
    for df, chars in zip(counted[1:], seen[1:], strict=True):
        tok, active = tok.union(df), active.union(chars)
    weights = options.priors or dict.fromkeys(options.texts, 1.0)
    total = sum(weights.values())
    rows = [(lang, weights[lang] / total, options.orders.get(lang, options.order), float(options.lm_power), float(options.keep_language)) for lang in options.texts]
    about = spark.createDataFrame(rows, "lang string, prior double, order int, power double, keep double")
    corpus.write_model({"tokens": tok, "active": active.distinct(), "about": about.coalesce(1)}, path)
    lm_store.write_store(lm.lookup(spark.read.schema("g string, t long, n int, lang string").parquet(f"{path}/tokens")), f"{path}/stats")


def load_languages(spark: SparkSession, path: str) -> tuple[dict[str, lm.Backoff], dict[str, float], dict[str, list[str]], float, int]:
    """Models, priors, active characters, probability to keep a language, and longest order, from ``initialize_language_model``."""
    tables = corpus.read_model(spark, path, ["active", "about"])
    about = {r["lang"]: r for r in tables["about"].collect()}  # a row a language
    stores = lm_store.open_store(spark, f"{path}/stats")
    models = {lang: lm.Backoff(stores[lang], r["order"], r["power"]) for lang, r in sorted(about.items())}
    chars: dict[str, list[str]] = {}
    for r in tables["active"].orderBy("lang", "char").collect():
        chars.setdefault(r["lang"], []).append(r["char"])
    return models, {lang: r["prior"] for lang, r in about.items()}, chars, next(iter(about.values()))["keep"], max(r["order"] for r in about.values())


# Fonts and glyph substitution


def font_of_images_arrays(inks: dict[str, np.ndarray], width: int) -> list[decoder.Template]:
    """Templates of one width from one image (columns x rows, 1 is black) for each character."""
    return [_template(c, [ink.astype(float)], width, width) for c, ink in sorted(inks.items())]


def _template(char: str, inks: list[np.ndarray], low: int, high: int) -> decoder.Template:
    black = np.mean([ink[np.minimum((np.arange(decoder.COLUMNS) * ink.shape[0]) // decoder.COLUMNS, ink.shape[0] - 1)] for ink in inks], axis=0)
    widths = decoder.fit_widths(np.bincount([min(max(ink.shape[0], low), high) for ink in inks], minlength=high + 1).astype(float), low, high)
    return decoder.Template(char, {low + k: math.log(p) for k, p in enumerate(widths) if p > 0}, np.log((black + 0.05) / (1.05 - black)))


def font_of_images(images: DataFrame, min_width: float = 0.0, max_width: float = 1.0) -> list[decoder.Template]:
    """Templates from images of characters (char, font, width, height, levels; all of the engine's line height).

    A template's weights are the log-odds of black, averaged over fonts after spreading each image over the template's columns; its
    widths are those between the fractions of the height, fitted to the images' widths. A font (some hundred characters) comes to
    the driver.
    """
    low, high = max(1, round(min_width * pages.HEIGHT)), max(1, round(max_width * pages.HEIGHT))
    looks: dict[str, list[np.ndarray]] = {}
    for r in images.select("char", "width", "height", "levels").collect():
        ink = (np.frombuffer(r["levels"], np.uint8).reshape(r["width"], r["height"]) < 128).astype(float)
        if r["height"] != pages.HEIGHT:
            raise ValueError(f"images of characters are {pages.HEIGHT} high")
        looks.setdefault(r["char"], []).append(ink)
    return [_template(char, inks, low, high) for char, inks in sorted(looks.items())]


def space_template(min_width: float = 0.0, max_width: float = 1.0) -> decoder.Template:
    """A space of any width between the fractions of the height, all alike."""
    widths = range(max(1, round(min_width * pages.HEIGHT)), max(1, round(max_width * pages.HEIGHT)) + 1)
    return decoder.Template(" ", {w: -math.log(len(widths)) for w in widths})


def rendered_characters(spark: SparkSession, chars: list[str], fonts: list[str]) -> DataFrame:
    """(char, font, width, height, levels): characters drawn by the fonts that the JVM has, cut to their ink, scaled to one box for all.

    Drawn on the driver through its headless graphics; an error if it has no fonts.
    """
    jvm = spark.sparkContext._jvm
    if not chars or not fonts:
        raise ValueError("no characters or no fonts")
    size, rows = pages.HEIGHT * 2, []
    for font in fonts:
        face = jvm.java.awt.Font(font, 0, pages.HEIGHT)
        shown = {}
        for char in chars:
            image = jvm.java.awt.image.BufferedImage(size * 2, size * 2, 10)
            pen = image.createGraphics()
            pen.setColor(jvm.java.awt.Color.WHITE)
            pen.fillRect(0, 0, size * 2, size * 2)
            pen.setColor(jvm.java.awt.Color.BLACK)
            pen.setFont(face)
            pen.drawString(char, size // 2, size + size // 4)
            pen.dispose()
            data = np.frombuffer(bytes(image.getRaster().getDataBuffer().getData()), np.uint8).reshape(size * 2, size * 2)
            shown[char] = data.T
        ink = np.stack([x < 128 for x in shown.values()])
        high = np.flatnonzero(ink.any(axis=(0, 1)))
        if not high.size:
            continue
        top, bottom = high[0], high[-1] + 1
        for char, x in shown.items():
            own = np.flatnonzero((x < 128).any(axis=1))
            if own.size:
                cut = pages.resample(x[own[0] : own[-1] + 1, top:bottom].astype(float))
                rows.append((char, font, cut.shape[0], cut.shape[1], bytearray(np.clip(cut, 0, 255).astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, "char string, font string, width int, height int, levels binary")


def initialize_font(spark: SparkSession, lm_path: str, path: str, images: DataFrame, allowed: str | None = None, template_widths: tuple[float, float] = (0.0, 1.0), space_widths: tuple[float, float] = (0.0, 1.0)) -> list[decoder.Template]:
    """A font for all characters of a language model from images (char, font, ...) of those fonts that a list allows; written to ``path``."""
    if allowed:
        images = corpus.allowed_fonts(images, corpus.path_list(spark, allowed))
    wanted = ngrams.indexed_chars(corpus.read_model(spark, lm_path, ["active"])["active"])
    font = font_of_images(images.join(F.broadcast(wanted), "char", "left_semi"), *template_widths)  # some hundred characters
    font = [t for t in font if t.char != " "] + [space_template(*space_widths)]
    training.font_frame(spark, font).write.mode("overwrite").parquet(path)
    return font


def initialize_gsm(spark: SparkSession, lm_path: str, path: str, smoothing: float = 1.0, elision: float = 100.0) -> None:
    """Glyph substitution before anything was read: the shares of the smoothing counts."""
    active = corpus.read_model(spark, lm_path, ["active"])["active"]
    grid = gsm.smoothing_grid(active, smoothing, elision).select("lang", "lm_char", "glyph", F.col("k").alias("c"))
    corpus.write_model({"probs": gsm.probabilities(grid)}, path)


# Lines


def extract_lines(spark: SparkSession, path: str | list[str], cache: str | None = None, skip: int = 0, take: int = 0, quantile: float = 0.12, crop: bool = True) -> DataFrame:
    """(doc_id, base_name, line_no, width, height, pixels) of the pages below ``path``; pages whose lines ``cache`` has are read from there."""
    raw = corpus.read_levels(spark, path)
    raw = corpus.skip_take(raw, "base_name", skip, take) if skip > 0 or take > 0 else raw
    levels = raw.withColumn("doc_id", F.xxhash64("base_name"))
    known = None
    if cache and training.path_exists(spark, cache):
        known = spark.read.parquet(cache).join(levels.select("doc_id").distinct(), "doc_id", "left_semi")
    fresh = pages.extract_lines(corpus.not_extracted(levels, known), quantile, crop)
    if cache:
        corpus.write_lines_cache(fresh, cache)
        known = spark.read.parquet(cache).join(levels.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = known if cache else fresh
    return lines.join(levels.select("doc_id", "base_name"), "doc_id")


# Training and transcription


@dataclass(frozen=True)
class Reading:
    """Options that training and transcription share, with their usual values."""

    formats: str = ""
    glyph_substitution: bool = False
    gsm_power: float = 4.0
    no_char_sub_prior: float = 0.9
    elide_anything: bool = False
    beam: int = 10
    decode_batch: int = 32
    padding: tuple[int, int] = (1, 5)
    vertical: range = decoder.OFFSETS
    markov_offset: bool = False
    switch_on_punctuation: bool = True
    updates: training.Updates = field(default_factory=lambda: training.Updates(font=False))

    def check(self, gsm_path: str | None) -> None:
        """Combinations that can't be meant are errors."""
        if self.glyph_substitution and gsm_path is None:
            raise ValueError("glyph substitution needs a model")
        if gsm_path is not None and not self.glyph_substitution:
            raise ValueError("a glyph substitution model without glyph substitution")
        if self.updates.glyphs and not self.glyph_substitution:
            raise ValueError("glyph substitution can't be updated when there is none")
        if (self.updates.language or self.updates.glyphs) and not self.updates.font:
            raise ValueError("language and glyph substitution models are updated together with the font only")

    def decoding(self) -> dict[str, Any]:
        return {"beam": self.beam, "batch": self.decode_batch, "pad": self.padding, "offsets": self.vertical}


def load_models(spark: SparkSession, lm_path: str, font_path: str, gsm_path: str | None, options: Reading) -> training.Models:
    """What reading begins with. A character of a language without a template in the font is an error."""
    options.check(gsm_path)
    languages, priors, chars, keep, order = load_languages(spark, lm_path)
    font = training.font_of(spark.read.parquet(font_path))
    missing = sorted({c for own in chars.values() for c in own} - {t.char for t in font})
    if missing:
        raise ValueError(f"no templates for {missing}")
    glyphs = None
    if options.glyph_substitution:
        active = spark.createDataFrame([(lang, c) for lang, own in chars.items() for c in own], "lang string, char string")
        glyphs = decoder.GlyphModel.of(corpus.read_model(spark, gsm_path, ["probs"])["probs"], active, elide_anything=options.elide_anything, no_sub=options.no_char_sub_prior, power=options.gsm_power)
    offsets = options.vertical if options.markov_offset else None
    return training.Models(font, languages, priors, chars, keep, order, glyphs, options.switch_on_punctuation, offsets)


def train_font(spark: SparkSession, lines: DataFrame, lm_path: str, font_path: str, output: str, rounds: int = 3, gsm_path: str | None = None, options: Reading = Reading(updates=training.Updates())) -> training.Models:  # noqa: B008
    """EM over lines (doc_id, line_no, width, height, pixels). The last font is written to ``output``/font-final, all last models to ``output``/models-final.

    A run that is started again goes on behind the last whole batch.
    """
    models = load_models(spark, lm_path, font_path, gsm_path, options)
    models = training.train_models(lines, models, output, rounds, options.updates, **options.decoding())
    versions.save(spark, models, f"{output}/models-final", f"{output}/font-final")
    return models


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs below ``path`` that were written whole."""
    if not training.path_exists(spark, path):
        return []
    folder, fs = training._folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("run=")]
    return sorted(int(n[4:]) for n in names if training.path_exists(spark, f"{path}/{n}/_SUCCESS"))


def last_decode(spark: SparkSession, path: str) -> DataFrame | None:
    """The decode table below ``path``: of each document the rows of the last whole run that read it."""
    known = runs(spark, path)
    if not known:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/run={k}" for k in known])
    if len(known) == 1:
        return rows.drop("run")
    last = rows.groupBy("doc_id").agg(F.max("run").alias("run"))
    return rows.join(last, ["doc_id", "run"], "left_semi").drop("run")


def transcribe(
    spark: SparkSession,
    lines: DataFrame,
    lm_path: str | None,
    font_path: str | None,
    output: str,
    gsm_path: str | None = None,
    options: Reading = Reading(),  # noqa: B008
    gold: DataFrame | None = None,
    skip_done: bool = False,
    fail_if_none: bool = False,
    gold_normalized: DataFrame | None = None,
    models_path: str | None = None,
    text_files: bool = False,
) -> dict[str, DataFrame]:
    """Read lines and write the asked formats below ``output``, a table for each: diplomatic and normalized lines, running texts, comparison, HTML, ALTO, layout.

    Models come from their paths, or all from the version at ``models_path`` (what training and updates write). With ``gold`` lines
    (doc_id, line_no, text) also scores by document and their averages; with ``gold_normalized`` lines those of the normalized
    running text. ``skip_done`` leaves out documents that ``output`` has already; a document that is read again replaces what was read
    before. Models may be updated on the way (``options.updates``); they are written to ``output``/models. ``text_files`` also writes the
    lines as text, a folder for each document.
    """
    formats = corpus.parse_formats(options.formats, options.glyph_substitution)
    done = f"{output}/decode"
    before = last_decode(spark, done)
    if skip_done and before is not None:
        lines = corpus.not_done(lines, before, fail_if_none=fail_if_none)
    models = versions.load(spark, models_path) if models_path else load_models(spark, lm_path, font_path, gsm_path, options)
    updates = options.updates
    number = max(runs(spark, done), default=0) + 1
    if updates.font or updates.language or updates.glyphs:
        place = f"{output}/update/run={number}"
        models = training.train_models(lines, models, place, 1, updates, **options.decoding())
        versions.save(spark, models, f"{output}/models")
        decoded = spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/decode/iter=1")
    else:
        decoded = decoder.decode(lines, models.font, models.transitions(), **options.decoding())
    decoded.write.mode("overwrite").parquet(f"{done}/run={number}")
    decode = last_decode(spark, done)
    languages = sorted(models.languages)
    made: dict[str, DataFrame] = {}
    if "DIPL" in formats:
        made["diplomatic"] = transcript.diplomatic_lines(decode)
    if "NORMLINES" in formats:
        made["normalized_lines"] = transcript.normalized_lines(decode)
    if "NORM" in formats:
        made["normalized"] = transcript.normalized_running(decode)
    if "HTML" in formats:
        made["html"] = transcript.html_lines(decode, languages)
    if "ALTO" in formats:
        made["alto"] = transcript.alto_pages(decode, options.glyph_substitution)
    if "WHITESPACE" in formats:
        made["whitespace"] = transcript.whitespace_layout(decode)
    gold_text = None if gold_normalized is None else corpus.gold_running(gold_normalized)
    if gold is not None:
        made["scores"] = scores(transcript.diplomatic_lines(decode), gold)
        made["report"] = evaluate.macro_average(made["scores"], ["metric"])
    if gold_text is not None:
        made["scores_normalized"] = evaluate.scores(gold_text.withColumnRenamed("text", "gold").join(transcript.normalized_running(decode).withColumnRenamed("text", "guess"), "doc_id", "left"), ["doc_id"])
        made["report_normalized"] = evaluate.macro_average(made["scores_normalized"], ["metric"])
    corpus.write_model(made, output)
    made = {name: spark.read.parquet(f"{output}/{name}") for name in made}
    if "COMP" in formats:
        norm, subs, running = (transcript.normalized_lines(decode), transcript.substitution_lines(decode), transcript.normalized_running(decode)) if options.glyph_substitution or gold_text is not None else (None, None, None)
        subs = subs if options.glyph_substitution else None
        evaluations = None
        for side, name in (("diplomatic", "scores"), ("normalized", "scores_normalized")):
            if name in made:
                own = made[name].withColumn("side", F.lit(side))
                evaluations = own if evaluations is None else evaluations.unionByName(own)
        report = transcript.comparison(transcript.diplomatic_lines(decode), gold, norm, gold_normalized, subs, running, gold_text, evaluations)
        corpus.write_model({"comparison": report}, output)
        made["comparison"] = spark.read.parquet(f"{output}/comparison")
    if text_files:
        for name in ("diplomatic", "normalized_lines"):
            if name in made:
                corpus.write_lines(made[name], f"{output}/all_transcriptions/{name}")
    return made


def scores(model: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, metric, cost, gold_len, score) of whole documents: lines as one text, all eight metrics; documents without gold are left out."""
    join = lambda df, name: df.groupBy("doc_id").agg(transcript.in_order(F.concat("text", F.lit(" ")), "line_no").alias(name))
    pairs = join(gold, "gold").join(join(model, "guess"), "doc_id", "left").withColumn("guess", F.coalesce("guess", F.lit("")))
    return evaluate.scores(pairs, ["doc_id"])
