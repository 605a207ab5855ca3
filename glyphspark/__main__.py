"""The programs from the command line: ``python -m glyphspark PROGRAM --option value ...`` (or with spark-submit on a cluster)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphspark import programs
from glyphspark.operators import training
from glyphspark.sources import corpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphspark", description=__doc__)
    commands = top.add_subparsers(dest="program", required=True)

    lm = commands.add_parser("initialize-lm", help="count texts into language models")
    lm.add_argument("--texts", required=True, help="lang->path,lang->path")
    for name in ("priors", "orders", "rules"):
        lm.add_argument(f"--{name}", default="", help="lang->value,lang->value")
    lm.add_argument("--lm-power", type=float, default=4.0)
    lm.add_argument("--keep-language", type=float, default=0.999999)
    lm.add_argument("--min-char-count", type=int, default=10)
    lm.add_argument("--lm-char-count", type=int, default=0)
    for name in ("insert-long-s", "remove-diacritics", "escapes"):
        lm.add_argument(f"--{name}", action="store_true")
    lm.add_argument("--output", required=True)

    gsm = commands.add_parser("initialize-gsm", help="glyph substitution before anything was read")
    gsm.add_argument("--lm", required=True)
    gsm.add_argument("--smoothing", type=float, default=1.0)
    gsm.add_argument("--elision", type=float, default=100.0)
    gsm.add_argument("--output", required=True)

    lines = commands.add_parser("extract-lines", help="cut pages into lines, kept as a table")
    lines.add_argument("--pages", required=True)
    lines.add_argument("--skip", type=int, default=0)
    lines.add_argument("--take", type=int, default=0)
    lines.add_argument("--output", required=True)

    for name, text in (("train-font", "EM over lines"), ("transcribe", "read lines and write the asked formats")):
        p = commands.add_parser(name, help=text)
        for option in ("lines", "lm", "font", "output"):
            p.add_argument(f"--{option}", required=name == "train-font" or option in ("lines", "output"))
        p.add_argument("--gsm", help="glyph substitution is allowed with such a model")
        p.add_argument("--update-lm", action="store_true")
        p.add_argument("--update-gsm", action="store_true")
        p.add_argument("--update-batch-docs", type=int, default=0)
        p.add_argument("--beam", type=int, default=10)
        p.add_argument("--decode-batch", type=int, default=32)
        p.add_argument("--markov-offset", action="store_true")
        if name == "train-font":
            p.add_argument("--rounds", type=int, default=3)
        else:
            p.add_argument("--update-font", action="store_true")
            p.add_argument("--models", help="a version of all models, instead of --lm, --font and --gsm")
            p.add_argument("--formats", default="")
            p.add_argument("--gold", help="folder of gold texts named after the pages")
            p.add_argument("--skip-done", action="store_true")
            p.add_argument("--text-files", action="store_true")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.program == "transcribe" and bool(a.models) == bool(a.lm or a.font):
        raise SystemExit("either --models or --lm and --font")
    spark = spark or SparkSession.builder.appName(f"glyphspark {a.program}").getOrCreate()
    if a.program == "initialize-lm":
        more = {k: getattr(a, k) for k in ("lm_power", "keep_language", "min_char_count", "lm_char_count", "insert_long_s", "remove_diacritics", "escapes")}
        programs.initialize_language_model(spark, programs.language_options(a.texts, a.priors, a.orders, a.rules, **more), a.output)
        return
    if a.program == "initialize-gsm":
        programs.initialize_gsm(spark, a.lm, a.output, a.smoothing, a.elision)
        return
    if a.program == "extract-lines":
        programs.extract_lines(spark, a.pages, None, a.skip, a.take).write.mode("overwrite").parquet(a.output)
        return
    updates = training.Updates(font=a.program == "train-font" or a.update_font, language=a.update_lm, glyphs=a.update_gsm, batch_docs=a.update_batch_docs)
    options = programs.Reading(formats=getattr(a, "formats", ""), glyph_substitution=a.gsm is not None, beam=a.beam, decode_batch=a.decode_batch, markov_offset=a.markov_offset, updates=updates)
    lines = spark.read.parquet(a.lines)
    if a.program == "train-font":
        programs.train_font(spark, lines, a.lm, a.font, a.output, a.rounds, a.gsm, options)
        return
    names = lines.select("doc_id", "base_name").distinct() if "base_name" in lines.columns else lines.select("doc_id", F.col("doc_id").cast("string").alias("base_name")).distinct()
    gold, normalized = corpus.read_gold(spark, a.gold, names) if a.gold else (None, None)
    programs.transcribe(spark, lines, a.lm, a.font, a.output, a.gsm, options, gold, a.skip_done, gold_normalized=normalized, models_path=a.models, text_files=a.text_files)


if __name__ == "__main__":
    main()
