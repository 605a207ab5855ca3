"""The programs one after another, as they are called from the command line."""

import pytest

from glyphspark import programs
from glyphspark.__main__ import main
from glyphspark.operators import pages, versions
from test_programs import OPTIONS, WIDTH, images, line_rows


def test_all_programs(spark, tmp_path, monkeypatch):
    for lang, text in (("la", "ab abba ba\nbaba ab ba\n"), ("es", "xy yx xyyx\nyx xy xy\n")):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "a.txt").write_text(text * 20)
    at = lambda name: str(tmp_path / name)
    main(["initialize-lm", "--texts", f"la->{at('la')},es->{at('es')}", "--orders", "3", "--lm-power", "1", "--keep-language", "0.6", "--output", at("lm")], spark)
    main(["initialize-gsm", "--lm", at("lm"), "--output", at("gsm")], spark)
    chars = [r["char"] for r in programs.ngrams.indexed_chars(spark.read.parquet(at("lm/active"))).collect()]
    width = WIDTH / pages.HEIGHT
    programs.initialize_font(spark, at("lm"), at("font"), images(spark, chars), None, (width, width), (0.1, 0.4))
    texts = {(1, 0): "ab ba", (2, 0): "xy yx"}
    line_rows(spark, texts).write.parquet(at("lines"))
    read = programs.Reading
    monkeypatch.setattr(programs, "Reading", lambda **more: read(**{**more, **OPTIONS}))  # the drawn letters' sizes
    main(["train-font", "--lines", at("lines"), "--lm", at("lm"), "--font", at("font"), "--output", at("train"), "--rounds", "1", "--update-lm"], spark)
    assert versions.exists(spark, at("train/models-final"))
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "1.txt").write_text("ab ba")
    for models in (["--models", at("train/models-final")], ["--lm", at("lm"), "--font", at("font")]):
        main(["transcribe", "--lines", at("lines"), *models, "--output", at("out"), "--gold", at("gold"), "--text-files"], spark)
        assert {(r["doc_id"], r["line_no"]): r["text"].strip() for r in spark.read.parquet(at("out/diplomatic")).collect()} == texts
    assert spark.read.parquet(at("out/report")).where("metric = 'CER, keep punc  '").first()["score"] == 0
    for wrong in (["transcribe", "--lines", "x", "--output", "y"], ["transcribe", "--lines", "x", "--output", "y", "--lm", "a", "--models", "b"], ["train-font"], []):
        with pytest.raises(SystemExit):
            main(wrong, spark)
