import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphspark.operators import evaluate as E
from glyphspark.operators import lm, ngrams
from glyphspark.sources import corpus


def _brute_kn(text_lines, order):
    tok = Counter(l[i:j] for l in text_lines for i in range(len(l)) for j in range(i + 1, min(len(l), i + order) + 1))
    after, before, around = defaultdict(set), defaultdict(set), defaultdict(set)
    for g in tok:
        if len(g) > 1:
            after[g[:-1]].add(g[-1])
            before[g[1:]].add(g[0])
            around[g[1:-1]].add((g[0], g[-1]))
    total = sum(n for g, n in tok.items() if len(g) == 1)

    def low(g):
        if len(g) == 1:
            return len(before[g]) / len(around[""])
        n = len(around[g[:-1]])
        return max(0, len(before[g]) - 0.75) / n + len(after[g[:-1]]) * 0.75 / n * low(g[1:])

    def p(g):
        if len(g) == 1:
            return tok[g] / total
        n = tok[g[:-1]]
        return max(0, tok[g] - 0.75) / n + len(after[g[:-1]]) * 0.75 / n * low(g[1:])

    return {g: p(g) for g in tok}


def test_kneser_ney(spark):
    random.seed(5)
    lines = ["".join(random.choice("abcd ") for _ in range(random.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(lines)], "doc_id long, text string, lang string")
    tok = ngrams.token_counts(ngrams.lines_of(docs), 4)
    got = {r["g"]: r["p"] for r in lm.kneser_ney(tok, 4).collect()}
    want = _brute_kn(lines, 4)
    assert set(got) == set(want)
    assert all(math.isclose(got[g], want[g], rel_tol=1e-9) for g in want)
    assert {r["g"] for r in lm.absolute_discount(tok, 3).collect()} == {g for g in want if len(g) <= 3}


def test_transitions(spark):
    lm.check_priors({"a": 0.5}, 1.0)
    for bad in (({}, 0.5), ({"a": 0.0}, 0.5), ({"a": 1.0}, 0.0), ({"a": 1.0}, 1.5)):
        with pytest.raises(ValueError):
            lm.check_priors(*bad)
    prior = spark.createDataFrame([("spanish", 0.5), ("latin", 0.3), ("nahuatl", 0.1)], "lang string, prior double")
    got = {(r[0], r[1]): r[2] for r in lm.transitions(prior, 0.8).collect()}
    assert math.isclose(got["spanish", "spanish"], 0.4 / 0.44) and math.isclose(got["latin", "nahuatl"], 0.01 / 0.30)
    one = lm.transitions(prior.where("lang = 'latin'"), 0.8).collect()
    assert [tuple(r) for r in one] == [("latin", "latin", 1.0)]


def _distance(a, b, f_for_s):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (not E.allowed(x, y, f_for_s)), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    random.seed(6)
    for _ in range(300):
        a = [random.choice(["f", "s", "a", "fs", "ss"]) for _ in range(random.randint(0, 12))]
        b = [random.choice(["f", "s", "a", "fs", "ss"]) for _ in range(random.randint(0, 12))]
        for allow in (False, True):
            d = E.edit_distance(a, b, allow)
            assert d == _distance(a, b, allow)
            steps = E.align(a, b, allow)
            assert sum(s[0] != "=" for s in steps) == d
            assert [s[1] for s in steps if s[1] is not None] == a and [s[2] for s in steps if s[2] is not None] == b
    assert E.edit_distance(["f"], ["s"], True) == 0 and E.edit_distance(["s"], ["f"], True) == 1


def test_alignment_in_small_memory(monkeypatch):
    rng = random.Random(1)
    pairs = [([rng.choice("fsab") for _ in range(rng.randrange(60))], [rng.choice("fsab") for _ in range(rng.randrange(60))]) for _ in range(150)]
    kept = [E.align(a, b, allow) for a, b in pairs for allow in (False, True)]
    monkeypatch.setattr(E, "KEEP_CELLS", 0)  # columns are made again, block by block
    assert [E.align(a, b, allow) for a, b in pairs for allow in (False, True)] == kept


def test_plain_glyphs_need_no_parsing():
    for text in ("", "añb é", "a\\'e", "e\u0301a", "x\\\\y", "日本"):
        parsed = [base + "".join(marks) for base, marks in E.parse(text, strict=False)]
        assert E.glyphs(text) == parsed


def test_long_lines_are_walked(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abc") for _ in range(n)), "".join(rng.choice("abcf") for _ in range(m))) for k, (n, m) in enumerate([(0, 0), (3, 5), (300, 290), (700, 5), (200, 400)])]
    got = {r["k"]: r["cost"] for r in E.char_costs(spark.createDataFrame(rows, "k long, guess string, gold string"), ["k"]).collect()}
    assert got == {k: _distance(list(a), list(b), False) for k, a, b in rows}


def test_scores(spark):
    pairs = spark.createDataFrame([(1, "fun, sun", "sun sun"), (2, "", ""), (3, None, "a")], "k long, guess string, gold string")
    got = {(r["k"], r["metric"]): (r["cost"], r["gold_len"], r["score"]) for r in E.scores(pairs, ["k"]).collect()}
    assert got[1, "CER, keep punc  "] == (2, 7, 2 / 7) and got[1, "CER, remove punc, allow f->s"] == (0, 7, 0.0)
    assert got[1, "WER, remove punc"] == (1, 2, 0.5) and got[2, "CER, remove punc"] == (0, 0, None) and got[2, "WER, remove punc"][1] == 1


def test_sources():
    assert corpus.parse_languages("la->x.txt,es->y.txt") == {"la": "x.txt", "es": "y.txt"}
    with pytest.raises(ValueError):
        corpus.LanguageModelOptions({"la": "x"}, priors={"es": 1.0})
    assert corpus.parse_formats("", False) == {"DIPL"}
    for bad in ("NORM", "XYZ"):
        with pytest.raises(ValueError):
            corpus.parse_formats(bad, False)
    for n in range(1, 40):
        for b in range(1, 12):
            batches, full = [], max(1, n // b)
            for i in range(1, n + 1):
                batches.append(min(-(-i // b), full))
            assert np.all(np.diff(batches) >= 0) and batches[-1] == full


def test_files(spark, tmp_path):
    (tmp_path / "rules.txt").write_text(" h\t \t2\n\nan\tã\t4\n")
    rules = corpus.read_rules(spark, str(tmp_path / "rules.txt"))
    assert [(r.old, r.new, r.every) for r in rules] == [(" h", " ", 2), ("an", "ã", 4)]
    (tmp_path / "bad.txt").write_text("a\tb\n")
    with pytest.raises(ValueError):
        corpus.read_rules(spark, str(tmp_path / "bad.txt"))
    folder = tmp_path / "texts" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("x\n\ny\n")
    (folder / ".hidden.txt").write_text("no")
    df = corpus.read_texts(spark, str(tmp_path / "texts"), "txt")
    assert [r[0] for r in df.select(corpus.as_stream(df.text)).collect()] == ["x y "]
    corpus.write_model({"m": spark.createDataFrame([("la", 1)], "lang string, n int")}, str(tmp_path / "model"))
    assert corpus.read_model(spark, str(tmp_path / "model"), ["m"])["m"].count() == 1
