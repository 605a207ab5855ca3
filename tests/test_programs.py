"""From text to models to transcriptions, with two languages; and the pieces that only programs join."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspark import programs
from glyphspark.functions import charset
from glyphspark.operators import decoder as D
from glyphspark.operators import gsm, lm, ngrams, pages, training, transcript
from glyphspark.sources import corpus
from glyphspark.streaming import incremental

WIDTH = 8


def glyph(char):
    """A look of its own for every character: 1 is black."""
    rng = np.random.default_rng(sum(ord(c) * (k + 1) for k, c in enumerate(char)) * 7919)
    return (np.kron(rng.random((WIDTH // 2, pages.HEIGHT // 3)), np.ones((2, 3))) < 0.45).astype(np.uint8)


def drawn(text):
    parts = [np.zeros((6, pages.HEIGHT), np.uint8)]
    for c in text:
        parts += [np.zeros((WIDTH, pages.HEIGHT), np.uint8) if c == " " else glyph(c), np.zeros((1, pages.HEIGHT), np.uint8)]
    return np.concatenate(parts)


def images(spark, chars):
    rows = [(c, "f1", WIDTH, pages.HEIGHT, bytearray(((1 - glyph(c)) * 255).astype(np.uint8).tobytes())) for c in chars]
    return spark.createDataFrame(rows, "char string, font string, width int, height int, levels binary")


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """A language model, a font and a glyph model of two languages."""
    path = tmp_path_factory.mktemp("models")
    for lang, text in (("la", "ab abba ba\nbaba ab ba\n"), ("es", "xy yx xyyx\nyx xy xy\n")):
        (path / lang).mkdir()
        (path / lang / "a.txt").write_text(text * 20)
    options = programs.language_options(f"la->{path}/la,es->{path}/es", "la->0.7,es->0.3", "3", lm_power=1.0, keep_language=0.6)
    programs.initialize_language_model(spark, options, f"{path}/lm")
    chars = [r["char"] for r in ngrams.indexed_chars(spark.read.parquet(f"{path}/lm/active")).collect()]
    width = WIDTH / pages.HEIGHT
    programs.initialize_font(spark, f"{path}/lm", f"{path}/font", images(spark, chars), None, (width, width), (0.1, 0.4))
    programs.initialize_gsm(spark, f"{path}/lm", f"{path}/gsm")
    return path


def line_rows(spark, texts):
    rows = []
    for (doc, number), text in texts.items():
        x = drawn(text)
        rows.append((doc, number, x.shape[0], x.shape[1], bytearray(x.tobytes())))
    return spark.createDataFrame(rows, "doc_id long, line_no int, width int, height int, pixels binary")


OPTIONS = {"padding": (1, 2), "vertical": range(0, 1), "beam": 20}


def test_language_model(spark, place):
    models, priors, chars, keep, order = programs.load_languages(spark, f"{place}/lm")
    assert set(models) == {"la", "es"} and priors == {"la": 0.7, "es": 0.3} and keep == 0.6 and order == 3
    assert "a" in chars["la"] and "x" not in chars["la"] and "&" in chars["es"]
    assert models["la"]("a", "b") > models["la"]("a", "x") == models["la"].raw("a", "x")
    total = sum(models["la"]("b", c) for c in "ab ")
    assert math.isclose(total, 1.0, rel_tol=1e-9)
    with pytest.raises(ValueError):
        programs.language_options("la->x", "es->1.0")


def test_transcription_with_two_languages(spark, place, tmp_path):
    texts = {(1, 0): "ab ba xy", (1, 1): "yx abba", (2, 0): "xyyx yx"}
    gold = spark.createDataFrame([(d, k, t) for (d, k), t in texts.items()], "doc_id long, line_no int, text string")
    options = programs.Reading(formats="DIPL,COMP,HTML,ALTO,WHITESPACE", **OPTIONS)
    made = programs.transcribe(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path), options=options, gold=gold)
    got = {(r["doc_id"], r["line_no"]): r["text"].strip() for r in made["diplomatic"].collect()}
    assert got == texts
    langs = {r["lm_char"]: r["lang"] for r in spark.read.parquet(f"{tmp_path}/decode").where("type = 'TMPL' and lm_char <> ' '").collect()}
    assert langs == {"a": "la", "b": "la", "x": "es", "y": "es"}
    assert {r["metric"]: r["score"] for r in made["report"].collect()}["CER, keep punc  "] == 0.0
    report = {r["doc_id"]: r["report"] for r in made["comparison"].collect()}[1]
    assert "MD: ab ba xy\nGD: ab ba xy\n\n" in report and "CER, keep punc  : 0.0\n" in report and "Diplomatic evaluation" in report
    assert '<font color="Blue">ab ba <font color="Red">xy' in made["html"].where("doc_id = 1 and line_no = 0").first()["html"] and made["alto"].count() == 2
    assert programs.transcribe(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path), options=programs.Reading(**OPTIONS), skip_done=True)["diplomatic"].count() == 3
    with pytest.raises(ValueError, match="transcribed"):
        programs.transcribe(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path), options=programs.Reading(**OPTIONS), skip_done=True, fail_if_none=True)


def test_transcription_with_substitution(spark, place, tmp_path):
    """A letter shown as another is read as what the language has; a doubled letter and a tilde are found."""
    texts = {(1, 0): "ab abbba"}
    options = programs.Reading(formats="DIPL,NORM,NORMLINES", glyph_substitution=True, no_char_sub_prior=0.5, gsm_power=1.0, **OPTIONS)
    made = programs.transcribe(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path), f"{place}/gsm", options)
    assert made["diplomatic"].first()["text"].strip() == "ab abbba"
    assert set(made) == {"diplomatic", "normalized", "normalized_lines"}
    with pytest.raises(ValueError):
        programs.transcribe(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path), None, options)


def test_training_updates_all_models(spark, place, tmp_path):
    texts = {(d, 0): t for d, t in enumerate(["ab ba", "xy yx", "abba ab", "xy xy", "ba ba"])}
    updates = training.Updates(font=True, language=True, glyphs=True, batch_docs=2)
    options = programs.Reading(glyph_substitution=True, updates=updates, **OPTIONS)
    models = programs.train_font(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path), 1, f"{place}/gsm", options)
    assert sorted(p.name for p in (tmp_path / "decode" / "iter=1").iterdir() if p.name.startswith("batch")) == ["batch=1", "batch=2"]
    second = spark.read.parquet(f"{tmp_path}/decode/iter=1/batch=2")
    assert {r["doc_id"] for r in second.select("doc_id").distinct().collect()} == {2, 3, 4}
    assert all(isinstance(m, lm.Mixture) for m in models.languages.values()) and math.isclose(sum(models.priors.values()), 1.0)
    assert models.glyphs.probs and all(p >= 0 for p in models.glyphs.probs.values())
    assert (tmp_path / "font-final").exists()


def test_reading_stream(spark, place, tmp_path):
    """Lines that arrive in two batches: the second is read with what the first taught, also after a restart."""
    options = programs.Reading(**OPTIONS)
    models = programs.load_models(spark, f"{place}/lm", f"{place}/font", None, options)
    source = str(tmp_path / "in")
    frames = [line_rows(spark, {(1, 0): "ab ba"}), line_rows(spark, {(2, 0): "xy yx"})]
    for k, frame in enumerate(frames):
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        incremental.reading_stream(stream, models, f"{tmp_path}/out", f"{tmp_path}/check", training.Updates(language=True), **options.decoding()).awaitTermination()
        decoded = spark.read.parquet(f"{tmp_path}/out/decode/batch={k}")
        assert transcript.diplomatic_lines(decoded).first()["text"].strip() == ("ab ba", "xy yx")[k]
    assert (tmp_path / "out" / "font" / "batch=1").exists()


def test_reestimated_models(spark):
    docs = spark.createDataFrame([(1, "abab", "la"), (2, "xyxy", "es")], "doc_id long, text string, lang string")
    base = lm.models_of(ngrams.token_counts(ngrams.lines_of(docs), 2), 2, 1.0)
    new = spark.createDataFrame([("la", "aaaa"), ("la", "ab")], "lang string, line string")
    models, priors = lm.reestimated(base, new, 2, 1.0)
    assert models["es"] is base["es"] and math.isclose(priors["la"], 7 / 8) and math.isclose(priors["es"], 1 / 8)
    fresh = lm.models_of(ngrams.token_counts(new, 2), 2, 1.0)["la"]
    assert math.isclose(models["la"]("a", "a"), 0.5 * base["la"]("a", "a") + 0.5 * fresh("a", "a"))
    again, _ = lm.reestimated(models, new, 2, 1.0)
    assert again["la"].parts[0][0] is base["la"] and len(again["la"].parts) == 2


def test_joint_log_prob_counts_equal_batches(spark):
    rows = [(1, 0, -10.0), (1, 0, -10.0), (1, 1, -10.0), (1, 2, -4.0), (2, 0, -1.0)]
    assert training.joint_log_prob(spark.createDataFrame(rows, "doc_id long, batch int, log_prob double")).first()[0] == (-8.0 - 1.0) / 2


def test_extracted_lines_are_kept(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "note.txt").write_text("no image")
    for name in ("b", "a"):
        image = jvm.java.awt.image.BufferedImage(120, 200, 1)
        for x in range(120):
            for y in range(200):
                black = y % 40 in range(15, 30) and x % 8 < 4 and 10 < x < 110
                image.setRGB(x, y, 0 if black else 0xFFFFFF)
        jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(f"{folder}/{name}.png"))
    levels = corpus.read_levels(spark, str(folder)).orderBy("base_name").collect()
    assert [(r["base_name"], r["width"], r["height"]) for r in levels] == [("a", 120, 200), ("b", 120, 200)]
    grid = np.frombuffer(levels[0]["levels"], np.uint8).reshape(120, 200)
    assert grid[16, 20] == 0 and grid[16, 5] == 255
    assert [r["base_name"] for r in corpus.read_images(spark, str(folder), 1, 1).collect()] == ["b"]
    cache = str(tmp_path / "cache")
    first = programs.extract_lines(spark, str(folder), cache, crop=False)
    n = first.count()
    assert n > 0 and first.select("base_name").distinct().count() == 2
    assert corpus.not_extracted(first.select("doc_id").distinct(), spark.read.parquet(cache)).count() == 0
    assert programs.extract_lines(spark, str(folder), cache, crop=False).count() == n == spark.read.parquet(cache).count()


def test_lists_of_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("img/p1- .png texts/p1.txt true 3\n\nq- .jpg q.txt false 0\n")
    rows = corpus.read_manifest(spark, f"{tmp_path}/list.txt").orderBy("line_no").collect()
    assert [(r["base_name"], r["line_no"], r["long_s"]) for r in rows] == [("p1", 0, True), ("p1", 1, True), ("p1", 2, True)]
    assert rows[2]["image_path"] == f"{tmp_path}/img/p1-2.png" and rows[0]["text_path"] == f"{tmp_path}/texts/p1.txt"
    (tmp_path / "bad.txt").write_text("only three fields\n")
    with pytest.raises(ValueError):
        corpus.read_manifest(spark, f"{tmp_path}/bad.txt")
    (tmp_path / "fonts.txt").write_text("f1\n")
    fonts = spark.createDataFrame([("f1", 1), ("f2", 2)], "font string, n int")
    assert [r["n"] for r in corpus.allowed_fonts(fonts, corpus.path_list(spark, f"{tmp_path}/fonts.txt")).collect()] == [1]
    lines = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "base_name string, line_no int")
    with pytest.raises(ValueError, match="'b'"):
        corpus.checked_lines(lines, "base_name")
    assert corpus.checked_lines(lines.where("base_name = 'a'"), "base_name").count() == 2


def test_limited_texts(spark):
    files = spark.createDataFrame([("x", "a", "abc\n\nde"), ("x", "b", "fgh\nij"), ("x", "c", "k"), ("y", "a", "abcdefgh")], "lang string, path string, text string")
    stream = lambda n: {(r["lang"], r["path"]): r[2] for r in corpus.take_chars(files, n).select("lang", "path", corpus.as_stream(F.col("text"))).collect()}
    assert stream(8) == {("x", "a"): "abc de ", ("x", "b"): "fgh ", ("y", "a"): "abcdefgh "}
    assert stream(4) == {("x", "a"): "abc ", ("y", "a"): "abcdefgh "}
    assert len(stream(0)) == 4
    docs = spark.createDataFrame([(1, "a\n\nb\nc", "x")], "doc_id long, text string, lang string")
    assert [r["line"] for r in ngrams.lines_of(docs, 3).collect()] == ["a", "b"]


def test_paths(tmp_path):
    assert corpus.output_path("/in/docs/sub/p1.jpg", "/in/docs/x", "/out") == "/out/all_transcriptions/sub/p1"
    assert corpus.output_path("/in/docs/p1.jpg", "/in/docs", "/out", 2, 1) == "/out/all_transcriptions/docs/p1_iter-2_batch-1"


def test_gsm_report(spark):
    active = spark.createDataFrame([("x", c) for c in "abe "], "lang string, char string")
    grid = gsm.smoothing_grid(active)
    counts = gsm.smoothed(spark.createDataFrame([("x", "e", "b", 5)], "lang string, lm_char string, glyph string, n long"), grid)
    rows = {(r["lmChar"], r["glyph"]): (r["count"], r["prob"], r["minProb"]) for r in corpus.gsm_report(counts, gsm.probabilities(counts)).collect()}
    assert rows["e", "b"][0] == 6.0 and rows["e", "b"][1] > rows["e", "b"][2] > 0 and ("e", "a") not in rows and ("a", "b") in rows


def test_indexed_chars(spark):
    got = {r["char"] for r in ngrams.indexed_chars(spark.createDataFrame([("é",), ("q",), ("\\",)], "char string")).collect()}
    assert {"é", "e", charset.tilde_form("e"), "q", charset.tilde_form("q"), "ſ", "Æ", "A", "E", "\\"} <= got


def glyph_model(**options):
    probs = {("x", c, g): 0.1 for c in "abs" for g in ["a", "b", "s", "ſ", "ELISION_TILDE", "TILDE_ELIDED", "FIRST_ELIDED", "DOUBLED", "ELIDED", "ã"]}
    return D.GlyphModel(probs, {"x": ["a", "b", "s", ".", " "]}, **options)


def test_glyph_choices():
    model = glyph_model()
    word, inside = D.State("TMPL", " ", "x"), D.State("TMPL", "a", "x", "a")
    assert set(model.choices(inside, "x", "s")) == {("s", "NORMAL_CHAR"), ("a", "NORMAL_CHAR"), ("b", "NORMAL_CHAR"), ("ſ", "NORMAL_CHAR"), ("s̃", "ELISION_TILDE"), ("s", "DOUBLED"), ("ſ", "DOUBLED")}
    assert (" ", "FIRST_ELIDED") in model.choices(word, "x", "a")
    assert (" ", "FIRST_ELIDED") not in model.choices(D.State("LMRGN_HPHN", "a", "x"), "x", "a")
    assert model.choices(D.State("TMPL", "a", "x", "ã", "ELISION_TILDE"), "x", "b") == [(" ", "TILDE_ELIDED")]
    assert model.choices(D.State("TMPL", "a", "x", "ã", "ELISION_TILDE"), "x", ".") == []
    assert (" ", "TILDE_ELIDED") in model.choices(D.State("TMPL", "b", "x", " ", "TILDE_ELIDED"), "x", "s")
    assert model.choices(inside, "x", ".") == [(".", "NORMAL_CHAR")]
    free = glyph_model(elide_anything=True)
    assert (" ", "ELIDED") in free.choices(inside, "x", "a") and (" ", "FIRST_ELIDED") not in free.choices(word, "x", "a")
    assert math.isclose(model.log_prob("x", "a", "a", "NORMAL_CHAR"), math.log(0.1 * 0.1**4 + 0.9)) and math.isclose(model.log_prob("x", "a", "b", "NORMAL_CHAR"), math.log(0.1 * 0.1**4))
    assert model.log_prob(None, " ", " ", "NORMAL_CHAR") == 0.0 and model.log_prob(None, "a", "a", "NORMAL_CHAR") == -math.inf


def two_languages(**options):
    prob = {lang: lambda context, c, own=own: {" ": 0.2, ".": 0.2}.get(c, 0.6 / len(own)) for lang, own in (("x", "ab"), ("y", "cd"))}
    return D.Transitions(prob, {"x": ["a", "b", ".", " "], "y": ["c", "d", ".", " "]}, {"x": 0.7, "y": 0.3}, {("x", "x"): 0.9, ("x", "y"): 0.1, ("y", "x"): 0.2, ("y", "y"): 0.8}, 3, **options)


def test_language_rules():
    model = two_languages()
    after = lambda s: {(t.lang, t.glyph): p for t, p in model.within(s) if t.type == "TMPL"}
    inside = after(D.State("TMPL", "a", "x", "a"))
    assert {lang for lang, _ in inside} == {"x"} and math.isclose(inside["x", "b"], math.log(0.5 * 0.3)) and math.isclose(inside["x", " "], math.log(0.5 * 0.2))
    space = after(D.State("TMPL", "a ", "x", " "))
    assert math.isclose(space["y", "c"], math.log(0.5 * 0.3 * 0.1)) and math.isclose(space["x", "a"], math.log(0.5 * 0.3 * 0.9))
    assert ("y", " ") not in space and math.isclose(space["y", "."], math.log(0.5 * 0.2 * 0.1))
    model = two_languages(switch_on_punctuation=False)
    space = after(D.State("TMPL", "a ", "x", " "))
    assert ("y", ".") not in space and math.isclose(space["x", "."], math.log(0.5 * 0.2))
    start = {(t.type, t.lang, t.glyph): p for t, p in model.start()}
    assert math.isclose(start["TMPL", "y", "c"], math.log(0.5 * 0.3 * 0.3)) and math.isclose(start["TMPL", None, " "], math.log(0.5 * 0.2)) and start["LMRGN", None, " "] == math.log(0.5)
    broken = {t.glyph for t, _ in model.next_line(D.State("RMRGN_HPHN", "a", "x", "-")) if t.type == "TMPL"}
    assert broken == {"a", "b"}
    line = {(t.type, t.lang, t.glyph): p for t, p in model.next_line(D.State("TMPL", "a", "x", "a"))}
    assert math.isclose(line["LMRGN", "x", " "], math.log(0.5 * 0.2)) and math.isclose(line["TMPL", "x", "b"], math.log(0.2 * 0.5 * 0.3)) and ("TMPL", "y", "c") not in line


def test_hyphens_and_doubles_with_substitution():
    model = two_languages(glyphs=D.GlyphModel({("x", c, k): 0.2 for c in "ab-" for k in ["a", "b", "DOUBLED", " ", "ELISION_TILDE", "TILDE_ELIDED"]}, {"x": ["a", "b", ".", " "], "y": ["c", "d", ".", " "]}))
    ends = {t.glyph for t, _ in model.within(D.State("TMPL", "a", "x", "a")) if t.type == "RMRGN_HPHN_INIT"}
    assert ends == {"-", " "}
    second = [t for t, _ in model.within(D.State("TMPL", "a", "x", "a", "DOUBLED")) if t.type == "TMPL"]
    assert second == [D.State("TMPL", "a", "x", "a")]
    assert {t.glyph_type for t, _ in model.within(D.State("TMPL", "a", "x", "ã", "ELISION_TILDE")) if t.type == "TMPL"} == {"TILDE_ELIDED"}
    assert not any(t.type == "TMPL" and t.lang is None for t, _ in model.start())
    assert not model.may_end(D.State("TMPL", "a", "x", "a", "DOUBLED"))


def test_missing_templates():
    font = [D.Template(c, {3: 0.0}, np.zeros((D.COLUMNS, D.HEIGHT))) for c in "abc.-"] + [D.Template(" ", {3: 0.0})]
    with pytest.raises(ValueError, match="'d'"):
        D.check_font(font, two_languages())


def test_vertical_offsets():
    steps = D.offset_steps(range(-5, 6))
    for b in range(-5, 6):
        assert math.isclose(sum(math.exp(p) for own in steps.values() for to, p in own.items() if to == b), 1.0)
    assert set(steps[0]) == {-2, -1, 0, 1, 2} and set(steps[5]) == {3, 4, 5}
    with pytest.raises(ValueError):
        two_languages(offsets=range(-1, 2))
    one = D.Transitions({"x": lambda context, c: 1 / 3}, {"x": ["a", "b", " "]}, {"x": 1.0}, {("x", "x"): 1.0}, 2, offsets=range(-2, 3))
    up, down = np.roll(glyph("a"), 1, axis=1), np.roll(glyph("b"), 2, axis=1)
    line = np.concatenate([up, np.zeros((1, 30), np.uint8), down, np.zeros((1, 30), np.uint8)])
    font = programs.font_of_images_arrays({"a": glyph("a"), "b": glyph("b"), "-": glyph("-")}, WIDTH) + [D.Template(" ", {4: 0.0})]
    em = D.Emission(line, font, (1, 1), range(-2, 3), True)
    states, score = D.decode_lines([em], one, 50)
    read = [(s.glyph, s.offset) for s, _, _ in states[0] if s.type == "TMPL"]
    assert [g for g, _ in read] == ["a", "b"] and score > -math.inf
    for s, at, width in states[0]:
        if s.type == "TMPL":
            assert em.explain(s.glyph, at, width, s.offset)[3] == s.offset
    assert abs(read[0][1] - read[1][1]) == 1


def test_look_ahead_keeps_the_best():
    """With what can follow in mind, a narrow beam finds what a wide one does."""
    model = two_languages()
    font = programs.font_of_images_arrays({c: glyph(c) for c in "abcd.-"}, WIDTH) + [D.Template(" ", {4: 0.0, 8: 0.0})]
    em = D.Emission(drawn("ab dc")[6:], font, (1, 1), range(0, 1))
    chars, pairs = model.pairs()
    beta = D.look_ahead(em, chars, pairs)
    assert beta.shape == (em.length + 1, len(chars)) and (beta[em.length] == 0).all()
    t, c = em.length - 9, chars.index("a")
    want = max((pairs[c, j] + em.best[x][w][t] for j, x in enumerate(chars) for w in em.best.get(x, {}) if t + w == em.length and t < em.best[x][w].size), default=-math.inf)
    assert beta[t, c] >= want
    wide, narrow = D.decode_lines([em], model, 5000)[1], D.decode_lines([em], model, 6)[1]
    assert math.isclose(wide, narrow, rel_tol=1e-9)


def test_comparison_without_gold(spark):
    model = spark.createDataFrame([(1, 0, "ab "), (1, 1, "c")], "doc_id long, line_no int, text string")
    gold = spark.createDataFrame([(1, 2, "x"), (2, 0, "y")], "doc_id long, line_no int, text string")
    got = {r["doc_id"]: r["report"] for r in transcript.comparison(model, gold).collect()}
    assert got[1] == "MD: Model diplomatic transcription\nGD: Gold diplomatic transcription\n\n\nMD: ab\nGD: \n\nMD: c\nGD: \n\nMD: \nGD: x\n\n\n\n"
    assert got[2].startswith("GD: Gold") and "MD" not in got[2]
    alone = transcript.comparison(model, running=spark.createDataFrame([(1, "ab c")], "doc_id long, text string")).first()["report"]
    assert alone.endswith("\n\nModel normalized transcription\nab c\n\n")


def test_drawn_fonts(spark):
    try:
        names = list(spark.sparkContext._jvm.java.awt.GraphicsEnvironment.getLocalGraphicsEnvironment().getAvailableFontFamilyNames())
    except Exception:  # a JVM without fonts or graphics
        names = []
    if not names:
        pytest.skip("the JVM has no fonts")
    rows = programs.rendered_characters(spark, ["a", "b"], names[:1]).collect()
    assert {r["char"] for r in rows} == {"a", "b"} and all(r["height"] == pages.HEIGHT for r in rows)
