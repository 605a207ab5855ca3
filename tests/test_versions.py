"""Stores of language models, versions of all models, restarts, runs of one output, counts of streams."""

import math
import pickle
import random
from contextlib import redirect_stdout
from io import StringIO

import pytest

from glyphspark import programs
from glyphspark.operators import lm, ngrams, training, versions
from glyphspark.sources import corpus
from glyphspark.streaming import incremental
from test_programs import OPTIONS, line_rows, place  # noqa: F401


def counts(spark, order, langs=("la", "es")):
    rng = random.Random(order)
    rows = [(k, langs[k % len(langs)], 0, "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 40)))) for k in range(80)]
    return ngrams.token_counts(spark.createDataFrame(rows, "doc_id long, lang string, line_no int, line string"), order)


@pytest.mark.parametrize("order", [1, 3, 6])
def test_store_is_the_dictionary(spark, tmp_path, order):
    tok = counts(spark, order, ("la", "01", "x/y"))
    plain: dict[str, dict] = {}
    for r in lm.lookup(tok).collect():
        plain.setdefault(r["lang"], {})[r["s"]] = (r["t"], r["low"], r["hist"], r["norm"])
    models = lm.models_of(tok, order, 1.0, str(tmp_path / "store"))
    assert set(models) == set(plain)
    rng = random.Random(1)
    for lang, own in plain.items():
        stats = models[lang].stats
        assert len(stats) == len(own) and all(stats[s] == v for s, v in own.items())
        assert stats.get("zzz") is None and "zzz" not in stats and stats.get("zzz", 5) == 5
        direct = lm.Backoff(own, order, 1.0)
        for _ in range(200):
            context, char = "".join(rng.choice("abcé z") for _ in range(rng.randrange(8))), rng.choice("abcé z")
            assert models[lang](context, char) == direct(context, char) and models[lang].shrink(context) == direct.shrink(context)
    assert len(pickle.dumps(models)) < 20_000  # names of shards, no counts


def test_tasks_read_the_store(spark):
    tok = counts(spark, 3)
    models = lm.models_of(tok, 3, 1.0)
    wanted = tok.where("lang = 'la' and n = 3").select("lang", "g").limit(50)

    def look(frames):
        for f in frames:
            yield f.assign(p=[models["la"](g[:-1], g[-1]) for g in f["g"]])

    got = {r["g"]: r["p"] for r in wanted.repartition(4).mapInPandas(look, "lang string, g string, p double").collect()}
    want = {r["g"]: r["p"] for r in lm.backed_off(wanted, tok, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in got)


def test_endings_are_found_in_one_exchange(spark):
    tok = training.versions.checkpointed(counts(spark, 4))
    rows = training.versions.checkpointed(lm.lookup(tok))
    out = StringIO()
    with redirect_stdout(out):
        found = lm.of_endings(rows.select("lang", "s"), rows, 4)
        found.explain("simple")
    # one for strings and statistics together; single characters (an alphabet) have their own join
    assert out.getvalue().split("== Physical Plan ==")[1].count("REPARTITION_BY_COL") == 1 and "Generate" not in out.getvalue()
    stats = {(r["lang"], r["s"]): (r["t"], r["low"], r["hist"], r["norm"]) for r in rows.collect()}
    for r in found.collect():
        assert [tuple(x) if x else None for x in r["v"]][: len(r["s"])] == [stats.get((r["lang"], r["s"][-i:])) for i in range(1, len(r["s"]) + 1)]


def read_all(spark, path):
    return sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(path).select("doc_id", "line_no", "pos", "lang", "lm_char", "glyph", "char_w").collect())


TEXTS = {(d, 0): t for d, t in enumerate(["ab ba", "xy yx", "abba ab", "xy xy", "ba ba"])}


def test_killed_training_goes_on(spark, place, tmp_path, monkeypatch):  # noqa: F811
    updates = training.Updates(font=True, language=True, glyphs=True, batch_docs=2)
    options = programs.Reading(glyph_substitution=True, updates=updates, **OPTIONS)
    run = lambda name, rounds=2: programs.train_font(spark, line_rows(spark, TEXTS), f"{place}/lm", f"{place}/font", str(tmp_path / name), rounds, f"{place}/gsm", options)
    whole = run("whole")
    save, commit, made = versions.save, versions.commit, []

    def killed(where):
        def f(*args, **more):
            made.append(1)
            if len(made) == where:
                raise KeyboardInterrupt
            return (commit if f.of == "commit" else save)(*args, **more)

        return f

    for k, name in enumerate(("save", "commit")):  # before a version is written, and when all but its manifest is
        made.clear()
        f = killed(2 + 2 * k)
        f.of = name
        with monkeypatch.context() as m:
            m.setattr(versions, name, f)
            with pytest.raises(KeyboardInterrupt):
                run(name)
        decoded = []
        with monkeypatch.context() as m:
            m.setattr(training, "decode", lambda lines, *a, _d=training.decode, **b: decoded.append(1) or _d(lines, *a, **b))
            again = run(name)
        assert 0 < len(decoded) < 4  # batches that were whole aren't read again
        assert read_all(spark, f"{tmp_path}/{name}/decode") == read_all(spark, f"{tmp_path}/whole/decode")
        assert again.priors == whole.priors and again.glyphs.probs == whole.glyphs.probs
        for lang in ("la", "es"):
            assert [again.languages[lang](c, x) for c in ("", "a", "ab", "xy") for x in "abxy "] == [whole.languages[lang](c, x) for c in ("", "a", "ab", "xy") for x in "abxy "]
        assert all((x.weights is None and y.weights is None) or (x.weights == y.weights).all() for x, y in zip(again.font, whole.font, strict=True))
    with pytest.raises(ValueError, match="other lines"):
        programs.train_font(spark, line_rows(spark, {(9, 0): "ab"}), f"{place}/lm", f"{place}/font", str(tmp_path / "whole"), 2, f"{place}/gsm", options)


def test_batches_are_read_by_folder(spark, tmp_path):
    lines = spark.createDataFrame([(d * 7 - 30, k, f"{d}-{k}") for d in range(23) for k in range(3)], "doc_id long, line_no int, pixels string")
    laid, batches = versions.laid_out(lines, str(tmp_path / "a"), 5)
    own = {r["doc_id"]: r["batch_no"] for r in laid.select("doc_id", "batch_no").distinct().collect()}
    assert batches == 4 and [own[d * 7 - 30] for d in range(23)] == [min(d // 5 + 1, 4) for d in range(23)] and laid.count() == lines.count()
    out = StringIO()
    with redirect_stdout(out):
        laid.where("batch_no = 2").explain("formatted")
    assert "PartitionFilters: [isnotnull(batch_no" in out.getvalue()
    assert versions.laid_out(lines, str(tmp_path / "b"), 0)[1] == 1 and versions.laid_out(lines.where("false"), str(tmp_path / "c"), 2)[1] == 1
    numbers = {r["doc_id"]: r["number"] for r in versions.numbered(lines.repartition(7), "doc_id").collect()}
    assert numbers == {d * 7 - 30: d + 1 for d in range(23)}


def test_versions_hold_everything(spark, place, tmp_path):  # noqa: F811
    options = programs.Reading(glyph_substitution=True, markov_offset=True, **OPTIONS)
    models = programs.load_models(spark, f"{place}/lm", f"{place}/font", f"{place}/gsm", options)
    versions.save(spark, models, str(tmp_path / "v"))
    again = versions.load(spark, str(tmp_path / "v"))
    assert (again.priors, again.chars, again.keep, again.order, again.offsets, again.switch_on_punctuation) == (models.priors, models.chars, models.keep, models.order, models.offsets, models.switch_on_punctuation)
    assert again.glyphs.probs == models.glyphs.probs and vars(again.glyphs).keys() == vars(models.glyphs).keys() and again.languages["la"]("a", "b") == models.languages["la"]("a", "b")
    with pytest.raises(FileNotFoundError):
        versions.load(spark, str(tmp_path / "none"))
    models.languages["la"] = lm.Backoff({}, 3)
    with pytest.raises(ValueError, match="store"):
        versions.save(spark, models, str(tmp_path / "w"))


def test_transcribing_twice(spark, place, tmp_path):  # noqa: F811
    texts = {(1, 0): "ab ba xy", (1, 1): "yx abba", (2, 0): "xyyx yx"}
    run = lambda rows, **more: programs.transcribe(spark, line_rows(spark, rows), f"{place}/lm", f"{place}/font", str(tmp_path / "out"), options=programs.Reading(**OPTIONS), **more)
    lines = lambda made: {(r["doc_id"], r["line_no"]): r["text"].strip() for r in made["diplomatic"].collect()}
    assert lines(run(texts)) == lines(run(texts)) == texts
    (tmp_path / "out" / "decode" / "run=2" / "_SUCCESS").unlink()  # a run that wasn't finished doesn't count
    assert programs.runs(spark, str(tmp_path / "out" / "decode")) == [1]
    more = {(1, 0): "ba", (3, 0): "xy"}  # document 1 is read again, with one line
    assert lines(run(more)) == {(1, 0): "ba", (2, 0): "xyyx yx", (3, 0): "xy"}
    assert lines(run({(3, 0): "ab", (4, 0): "ab"}, skip_done=True)) == {(1, 0): "ba", (2, 0): "xyyx yx", (3, 0): "xy", (4, 0): "ab"}


def test_updated_models_are_written(spark, place, tmp_path):  # noqa: F811
    updates = training.Updates(font=True, language=True)
    made = programs.transcribe(spark, line_rows(spark, TEXTS), f"{place}/lm", f"{place}/font", str(tmp_path / "a"), options=programs.Reading(updates=updates, **OPTIONS), text_files=True)
    assert {r["doc_id"]: r["text"].strip() for r in made["diplomatic"].collect()} == {d: t for (d, _), t in TEXTS.items()}
    assert (tmp_path / "a" / "all_transcriptions" / "diplomatic" / "doc_id=0").exists()
    models = versions.load(spark, str(tmp_path / "a" / "models"))
    assert all(isinstance(m, lm.Mixture) for m in models.languages.values())
    again = programs.transcribe(spark, line_rows(spark, {(7, 0): "ab xy"}), None, None, str(tmp_path / "b"), options=programs.Reading(**OPTIONS), models_path=str(tmp_path / "a" / "models"))
    assert again["diplomatic"].first()["text"].strip() == "ab xy"


def test_gold_of_files(spark, place, tmp_path):  # noqa: F811
    texts = {(1, 0): "ab ba", (1, 1): "xy", (2, 0): "yx"}
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "one.txt").write_text("ab ba\nxy\n")
    (tmp_path / "gold" / "one_normalized.txt").write_text("ab ba\nyy\n")
    docs = spark.createDataFrame([(1, "scans/one.png"), (2, "two.jpg")], "doc_id long, base_name string")
    gold, normalized = corpus.read_gold(spark, str(tmp_path / "gold"), docs)
    assert sorted(tuple(r) for r in gold.collect()) == [(1, 0, "ab ba"), (1, 1, "xy")]
    options = programs.Reading(formats="DIPL,COMP", **OPTIONS)
    made = programs.transcribe(spark, line_rows(spark, texts), f"{place}/lm", f"{place}/font", str(tmp_path / "out"), options=options, gold=gold, gold_normalized=normalized)
    assert {r["metric"]: r["score"] for r in made["report"].collect()}["CER, keep punc  "] == 0.0
    assert {r["metric"]: (r["score"], r["docs"]) for r in made["report_normalized"].collect()}["CER, keep punc  "] == (1 / 8, 1)
    report = {r["doc_id"]: r["report"] for r in made["comparison"].collect()}
    assert "MN: xy\nGN: yy\nMD: xy\nGD: xy\n" in report[1] and "Normalized evaluation" in report[1] and "GN" not in report[2]
    with pytest.raises(ValueError, match="gold"):
        corpus.read_gold(spark, str(tmp_path / "gold"), docs.where("doc_id = 2"))


def test_options_that_exclude_each_other(spark, place, tmp_path):  # noqa: F811
    wrong = [
        (None, programs.Reading(glyph_substitution=True)), ("x", programs.Reading()), (None, programs.Reading(updates=training.Updates(glyphs=True))),
        (None, programs.Reading(updates=training.Updates(font=False, language=True))),
    ]
    for gsm, options in wrong:
        with pytest.raises(ValueError):
            programs.load_models(spark, f"{place}/lm", f"{place}/font", gsm, options)
    spark.read.parquet(f"{place}/font").where("char <> 'a'").write.parquet(str(tmp_path / "font"))
    with pytest.raises(ValueError, match="templates.*'a'"):
        programs.load_models(spark, f"{place}/lm", str(tmp_path / "font"), None, programs.Reading())


def test_streamed_counts(spark, tmp_path):
    """Totals after many micro-batches, with compaction, are the counts of all documents; a batch that runs again changes nothing."""
    rng = random.Random(3)
    docs = [[(10 * k + j, "".join(rng.choice("ab\n ") for _ in range(12)), rng.choice(["la", "es"])) for j in range(3)] for k in range(7)]
    schema = "doc_id long, text string, lang string"
    for k, own in enumerate(docs):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.ngram_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), 3, compact_every=3).awaitTermination()
        if k == 4:  # the last batch's commit is lost: it runs again
            (tmp_path / "check" / "commits" / "4").unlink()
            (tmp_path / "check" / "commits" / ".4.crc").unlink(missing_ok=True)
        whole = ngrams.token_counts(ngrams.lines_of(spark.createDataFrame(sum(docs[: k + 1], []), schema)), 3)
        got = incremental.counts_so_far(spark, str(tmp_path / "out"))
        assert sorted(map(tuple, got.select("lang", "g", "n", "t").collect())) == sorted(map(tuple, whole.select("lang", "g", "n", "t").collect()))
    assert sorted(p.name for p in (tmp_path / "out" / "whole").iterdir()) == ["2", "5"] and not (tmp_path / "out" / "changed" / "0").exists()


def test_perplexity_of_powered_models(spark):
    """Powers belong to the characters' probabilities: logarithms of these are multiplied, those of languages stay."""
    tok = versions.checkpointed(counts(spark, 2))
    prior = spark.createDataFrame([("la", 0.6), ("es", 0.4)], "lang string, prior double")
    runs = spark.createDataFrame([(1, 1, "la", "ab "), (1, 2, "es", "ca")], "doc_id long, run int, lang string, text string")
    prob = versions.checkpointed(lm.backed_off(lm.run_contexts(runs, 2, "doc_id"), tok, 2))
    move = lm.transitions(prior, 0.8)
    one, four = (lm.run_perplexity(runs, prob, prior, move, 2, power=p).first()["perplexity"] for p in (1.0, 4.0))
    logs = {(r["lang"], r["g"]): math.log(r["p"]) for r in prob.collect()}
    chars = sum(logs[x] for x in (("la", "a"), ("la", "ab"), ("la", "b "), ("es", "c"), ("es", "ca")))
    change = {(r[0], r[1]): r[2] for r in move.collect()}["la", "es"]
    for p, got in ((1.0, one), (4.0, four)):
        assert math.isclose(got, math.exp(-(p * chars + math.log(0.6) + math.log(change)) / 5))
    lines = spark.createDataFrame([(1, "la", 0, "ab ca")], "doc_id long, lang string, line_no int, line string")
    own = lm.backed_off(ngrams.contexts(lines, 2, ("lang",)), tok, 2)
    plain, raised = (lm.perplexity(lines, own, 2, power=p).first()["perplexity"] for p in (1.0, 4.0))
    assert math.isclose(raised, plain**4)
