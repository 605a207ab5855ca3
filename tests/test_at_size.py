"""What queries move and hold as their tables grow."""

import random

import pytest

from glyphspark.functions import charset, readers
from glyphspark.operators import bands, cascade, evaluate, ngrams, transcript
from glyphspark.plans import catalogue

DATA = "/root/testdata/sf0.001"
OF_LINES = ["alto_pages", "alto_words", "comparison_report", "diplomatic_lines", "html_lines", "language_runs", "normalized_lines", "normalized_running", "substitution_lines", "whitespace_layout", "word_spans"]


@pytest.mark.parametrize("name", OF_LINES)
def test_states_stay_in_their_tasks(spark, name):
    """What an exchange moves is text; the states of a line are made above it."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[-1]
    assert "hashpartitioning(doc_id" in below and "glyph" not in below and "LMRGN" not in below


def test_packed_lines_and_rows_are_alike(spark):
    lines = spark.createDataFrame([(1, 0, "fr", "a-- so, é  x"), (1, 1, "fr", "   "), (1, 2, "de", "s" * 60 + " ab"), (2, 0, None, "abc d.e"), (3, 1, "en", "-")], "doc_id long, line_no int, lang string, line string")
    rows, whole = transcript.decode_fixture(lines), transcript.packed_fixture(lines)
    assert whole.count() == lines.count() and rows.count() > 80
    for f in (transcript.diplomatic_lines, transcript.normalized_lines, transcript.normalized_running, transcript.language_runs, transcript.word_spans, transcript.alto_items, transcript.alto_pages, transcript.substitution_lines, transcript.whitespace_layout, lambda d: transcript.html_lines(d, ["de", "fr"])):
        assert sorted(f(rows).collect()) == sorted(f(whole).collect())


def test_ngrams_are_counted_before_they_move(spark, monkeypatch):
    """Equal to a row a character; a task hands over its distinct n-grams, by chunks."""
    monkeypatch.setattr(ngrams, "CHUNK", 300)
    rows = [(k % 2, "fr" if k % 3 else None, x) for k, x in enumerate(["abab" * 50, "é\U0001f600a\x00b", "", None, "\x00\x00a", "abc", "a b c d e f g"])]
    lines = spark.createDataFrame(rows, "doc_id long, lang string, line string").coalesce(1)
    for order in (1, 2, 3, 4, 6):
        for keys in ((), ("lang",), ("doc_id", "lang")):
            want = ngrams.grams(lines.where("line <> ''"), order, keys).groupBy(*keys, "g").count().collect()
            assert sorted(map(tuple, ngrams.contexts(lines, order, keys).collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert ngrams.counted_in_parts(lines, 3, ("lang",)).count() < 60


def test_characters_are_counted_where_they_are(spark):
    """Counts equal the parser's; no array of characters comes back from a task."""
    texts = ["", "abc", "é ñ", "e\u0301a\u0303\u0304", "\\'e\\", "\\\\x", "\u0301a", "\U0001f600b", None]
    df = spark.createDataFrame([(x,) for x in texts], "line string").select("line", charset.count_chars("line").alias("n"))
    assert [(r["line"], r["n"]) for r in df.collect()] == [(x, None if x is None else len(charset.split_chars(x, strict=False))) for x in texts]
    assert "read_chars" not in catalogue.QUERIES["char_split"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("words", [False, True])
def test_pairs_are_compared_together(monkeypatch, words):
    """F5 F6 F16 F20 to F26: costs and steps, ties too, of pairs that walk together are those of single pairs; wide bands and long lines are among them."""
    monkeypatch.setattr(bands, "LEAST", 2)
    draw, cut = random.Random(7), (lambda x: x.split(" ")) if words else evaluate.glyphs
    pairs = [("", ""), ("", "ab"), ("f", ""), ("\\'e f\u0304*", "e\u0301 s\u0304s")]
    for n in [1, 30, 63, 64, 65, 150, 300, 700] * 4:
        gold = [draw.choice("abfs uv") for _ in range(n)]
        guess = [draw.choice("abfs uv") if draw.random() < 0.2 else x for x in gold if draw.random() < 0.9]
        pairs += [("".join(guess), "".join(gold)), ("ab" * draw.randrange(60) + "".join(guess), "".join(gold)), ("".join(guess), "".join(guess))]
    guesses, golds = map(list, zip(*pairs, strict=True))
    for allow in (False, True):
        alone = []
        monkeypatch.setattr(evaluate, "align", lambda *x, f=evaluate.align, seen=alone: seen.append(x) or f(*x))
        costs, steps = evaluate.compared((evaluate.cut_words if words else evaluate.cut_characters)(guesses, golds, allow), allow, keep=True)
        assert len(alone) < len(pairs) / 4
        monkeypatch.undo()
        monkeypatch.setattr(bands, "LEAST", 2)
        for (a, b), c, own in zip(pairs, costs, steps, strict=True):
            assert "".join("=SID"[k] for k in own) == "".join(s[0] for s in evaluate.align(cut(a), cut(b), allow))
            assert c == evaluate.edit_distance(cut(a), cut(b), allow)


def test_alignments_are_made_once_above_the_exchange(spark):
    """F5 F16: equal steps don't leave their tasks, and no condition on steps is tested below the exchange."""
    plan = catalogue.QUERIES["alignment_ops"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in plan.split("Exchange")[-1]
    assert "Window" not in catalogue.QUERIES["error_confusions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_rules_walk_once_where_marks_are(monkeypatch):
    """a mark somewhere in the text doesn't make rules go match by match; rows are as by ``walk``."""
    lines = ["que\u0303 que q\u0303an", "", "anan an\u0303 ban", "uvuvuu\u0301"] * 40
    rules = [readers.Rule("que", "q\u0303", 2), readers.Rule("an", "\xe3", 3), readers.Rule("u", "vw", 4), readers.Rule("v", "", 5)]
    want = readers.replace_some_in_order(lines, rules)
    monkeypatch.setattr(cascade, "walk", None)
    monkeypatch.setattr(cascade, "CHUNK", 50)
    assert cascade.cascade(lines, rules, [0] * len(rules)) == want
