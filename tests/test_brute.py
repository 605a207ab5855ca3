"""Queries without SQL against plain loops over the same rows, and operators against other ways to compute them."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphspark.functions import charset as C
from glyphspark.functions import readers as R
from glyphspark.functions import text as X
from glyphspark.operators import evaluate as E
from glyphspark.operators import lm, ngrams
from glyphspark.operators.cascade import replace_in_order
from glyphspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    """(doc, line): gold and guess as the evaluation queries have them."""
    out = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for k, line in enumerate((r["text"] or "").split("\n")):
            if line:
                plain = "".join(c if ord(c) < 128 else unicodedata.normalize("NFD", c)[0] for c in line)
                gold = re.sub("[^ -~]", "", plain)
                out[r["doc_id"], k] = (gold, gold.translate(str.maketrans("uvs", "vuf")))
    return out


def distance(a, b, same):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (not same(x, y)), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def like(guess, gold):
    """The allowance of f for s, written out: a letter f for an s; words of one length where only such letters differ, as far as it goes."""
    if guess == gold:
        return True
    if len(guess) == len(gold) == 1:
        return (guess, gold) == ("f", "s")
    return len(guess) == len(gold) and all(y == "s" if x in "fs" else x == y for x, y in zip(guess, gold, strict=True))


def test_wer_line(spark, pairs):
    got = {(r["doc_id"], r["line_no"], r["metric"]): (r["cost"], r["gold_len"], r["score"]) for r in catalogue.QUERIES["wer_line"](spark, DATA).collect()}
    assert len(got) == 8 * len(pairs)
    rng = random.Random(3)
    short = [k for k, (gold, _) in pairs.items() if len(gold) < 90]
    for key in rng.sample(short, 250):
        gold, guess = pairs[key]
        for punc in ("keep", "remove"):
            tidy = lambda t: " ".join((re.sub("[^ A-Za-z0-9]", "", t) if punc == "remove" else t).split())  # noqa: B023, E731
            g, h = tidy(guess), tidy(gold)
            for allow in (False, True):
                same = like if allow else (lambda a, b: a == b)
                tail = ", allow f->s" if allow else "  " if punc == "keep" else ""
                for kind, a, b in (("CER", list(g), list(h)), ("WER", g.split(" "), h.split(" "))):
                    cost = distance(a, b, same)
                    assert got[*key, f"{kind}, {punc} punc{tail}"] == (cost, len(b), cost / len(b) if b else None), (key, kind, punc, allow)


@pytest.fixture(scope="module")
def aligned(pairs):
    """Steps of every line, by letters and by words."""
    out = {}
    for words in (False, True):
        steps = {}
        for key, (gold, guess) in pairs.items():
            guess = re.sub("(?:the|la|de|der) ", "", guess)
            tidy = lambda t: " ".join(t.split())
            a, b = (tidy(guess).split(" "), tidy(gold).split(" ")) if words else (list(tidy(guess)), list(tidy(gold)))
            steps[key] = E.align(a, b)
            if len(a) < 60:
                assert sum(s[0] != "=" for s in steps[key]) == distance(a, b, lambda x, y: x == y)
        out[words] = steps
    return out


def test_alignment_ties():
    """Equal, substitution, insertion, deletion, in this order, from the end: a full table written out."""
    rng = random.Random(12)
    for _ in range(400):
        a, b = ([rng.choice(["f", "s", "a", "fs", "ss"]) for _ in range(rng.randrange(9))] for _ in range(2))
        for allow in (False, True):
            table = [[distance(a[:i], b[:j], lambda x, y: E.allowed(x, y, allow)) for j in range(len(b) + 1)] for i in range(len(a) + 1)]  # noqa: B023
            i, j, want = len(a), len(b), []
            while i or j:
                same = i and j and E.allowed(a[i - 1], b[j - 1], allow)
                if same and table[i][j] == table[i - 1][j - 1]:
                    want.append("=")
                    i, j = i - 1, j - 1
                elif i and j and table[i][j] == table[i - 1][j - 1] + 1:
                    want.append("S")
                    i, j = i - 1, j - 1
                elif j and table[i][j] == table[i][j - 1] + 1:
                    want.append("I")
                    j -= 1
                else:
                    want.append("D")
                    i -= 1
            assert "".join(s[0] for s in E.align(a, b, allow)) == "".join(want[::-1]), (a, b, allow)
            assert E.edit_distance(a, b, allow) == table[-1][-1]


def rows(spark, name):
    return catalogue.QUERIES[name](spark, DATA).collect()


def test_alignment_ops(spark, aligned):
    assert {(r["doc_id"], r["line_no"]): r["ops"] for r in rows(spark, "alignment_ops")} == {i: "".join(s[0] for s in steps) for i, steps in aligned[False].items() if steps}


def test_error_confusions(spark, aligned):
    want = Counter()
    for steps in aligned[False].values():
        ops = ["=", *[s[0] for s in steps], "="]
        for k, (op, guess, gold) in enumerate(steps):
            if op != "=":
                want[op, guess, gold, ops[k] == "=" == ops[k + 2]] += 1
    assert {(r["op"], r["guess"], r["gold"], r["isolated"]): r["n"] for r in rows(spark, "error_confusions")} == want


def test_word_errors(spark, aligned):
    steps = [s for own in aligned[True].values() for s in own]
    length, wrong, missed, far = Counter(), Counter(), Counter(), Counter()
    for op, guess, gold in steps:
        if gold is not None:
            length[min(len(gold), 10)] += 1
            wrong[min(len(gold), 10)] += op != "="
            missed[gold] += op != "="
        if op == "S":
            far[min(distance(guess, gold, lambda x, y: x == y), 10)] += 1
    assert {r["length"]: (r["total"], r["wrong"]) for r in rows(spark, "errors_by_length")} == {k: (n, wrong[k]) for k, n in length.items()}
    assert {r["distance"]: r["n"] for r in rows(spark, "confusion_distances")} == far
    assert [(r["gold"], r["n"]) for r in rows(spark, "top_missed_words")] == sorted(((w, n) for w, n in missed.items() if n), key=lambda x: (-x[1], x[0]))[:20]
    sample = [(r["doc_id"], r["line_no"], r["idx"], r["op"], r["guess"], r["gold"]) for r in rows(spark, "error_sample")]
    errors = {(*i, k, *s) for i, own in aligned[True].items() for k, s in enumerate(own) if s[0] != "="}
    assert len(sample) == min(50, len(errors)) and set(sample) <= errors and sample == sorted(sample, key=lambda x: x[:3])


@pytest.mark.parametrize(("lines", "rule", "want"), [(["xxxx"], ("xx", "a", 1), ["aa"]), (["xxxx"], ("xx", "ax", 1), ["axax"]), (["xxxx"], ("xx", "a", 2), ["xax"]), (["ababa", "aba"], ("aba", "-", 2), ["ab-", "aba"])])
def test_overlapping_rules(spark, lines, rule, want):
    assert R.replace_some_in_order(lines, [R.Rule(*rule)]) == want
    frame = spark.createDataFrame([(k, 0, "x", t) for k, t in enumerate(lines)], "doc_id long, line_no int, lang string, line string")
    assert [r["line"] for r in R.replace_some(frame, [R.Rule(*rule)]).orderBy("doc_id").collect()] == want


def in_order(texts, rules):
    """Every rule over each line in turn, symbol by symbol."""
    counts, out = [0] * len(rules), []
    for line in texts:
        glyphs = C.split_chars(line)
        for k, r in enumerate(rules):
            old, new, done, at = C.split_chars(r.old), C.split_chars(r.new), [], 0
            while at < len(glyphs):
                hit = glyphs[at : at + len(old)] == old
                if hit and counts[k] % r.every == r.every - 1:
                    done += new
                    at += len(old)
                else:
                    done.append(glyphs[at])
                    at += 1
                counts[k] += hit
            glyphs = done
        out.append("".join(C.unescape_char(g) for g in glyphs))
    return out


@pytest.mark.parametrize(("rules", "letters"), [
    ([R.Rule("xx", "z", 3), R.Rule("y", "xx", 2), R.Rule("xxx", "q", 2)], "xxy"),
    ([R.Rule("ab", "ba", 2), R.Rule("ba", "ab", 3), R.Rule("aa", "b", 2), R.Rule("b", "aa", 5), R.Rule("a", "ab", 1), R.Rule("bab", "", 4)], "ab"),
    (R.parsed_rules(catalogue.SPANISH_RULES), ["que", "per", "ci", "ce", "x", "j", "an", "en", "in", "on", "un", " h", "be", "u", "v", "á", "è", "ae", "oracion", "ñ", " ", "q̃"]),
])
@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_rules_over_blocks(spark, rules, letters, blocks):
    rng = random.Random(len(rules))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(600)]
    ids = sorted(rng.sample(range(-(10**12), 10**12), 600))
    rows = [(i, 0, "a" if k % 3 else None, t, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    frame = spark.createDataFrame([*rows, (5, 1, "a", None, -1)], "doc_id long, line_no int, lang string, line string, extra int")
    want = {}
    for group in ("a", None):
        own = [(r[0], r[3]) for r in rows if r[2] == group]
        plain = in_order([t for _, t in own], rules)
        assert plain == R.replace_some_in_order([t for _, t in own], rules)
        want |= dict(zip([i for i, _ in own], plain, strict=True))
    got = replace_in_order(frame.repartition(5), rules, "lang", ("doc_id", "line_no"), "line", blocks).collect()
    assert {r["doc_id"]: r["line"] for r in got if r["line_no"] == 0} == want
    assert sorted(r["extra"] for r in got) == list(range(-1, 600)) and [r["line"] for r in got if r["line_no"]] == [None]


def test_rules_are_one_exchange(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    frame = spark.createDataFrame([(1, 0, "a", "que u v")], "doc_id long, line_no int, lang string, line string")
    out = StringIO()
    with redirect_stdout(out):
        R.replace_some(frame, R.parsed_rules(catalogue.SPANISH_RULES)).explain("simple")
    assert out.getvalue().count("MapInArrow") == 1 and "Exchange" not in out.getvalue()  # what was laid out is read
    assert R.replace_some(frame.where("false"), R.parsed_rules(catalogue.SPANISH_RULES)).collect() == []
    for bad in ([R.Rule("", "x", 1)], [R.Rule("x", "y", 0)]):
        with pytest.raises(ValueError):
            R.replace_some(frame, bad)
    with pytest.raises(ValueError):
        R.parsed_rules("a\tb\t1\nc d 2")


def brute_backoff(lines, order, kind):
    tok = Counter(t[i:j] for t in lines for i in range(len(t)) for j in range(i + 1, min(len(t), i + order) + 1))
    after, before, around = ({} for _ in range(3))
    for g in tok:
        if len(g) > 1:
            after.setdefault(g[:-1], set()).add(g[-1])
            before.setdefault(g[1:], set()).add(g[0])
            around.setdefault(g[1:-1], set()).add((g[0], g[-1]))
    total = sum(n for g, n in tok.items() if len(g) == 1)
    count = lambda table, s: len(table.get(s, ()))

    def kn(g):
        if len(g) == 1:
            return count(before, g) / count(around, "") if count(before, g) else lm.UNSEEN
        n = count(around, g[:-1])
        return max(0, count(before, g) - 0.75) / n + count(after, g[:-1]) * 0.75 / n * kn(g[1:]) if n else kn(g[1:])

    def absolute(g):
        if len(g) == 1:
            return tok[g] / total if tok[g] else lm.UNSEEN
        return max(0, tok[g] - 0.75) / tok[g[:-1]] + count(after, g[:-1]) * 0.75 / tok[g[:-1]] * absolute(g[1:])

    def p(whole):
        g = whole
        while len(g) > 1 and not tok[g[:-1]]:
            g = g[1:]
        if kind == "mle":
            return tok[g] / (tok[g[:-1]] if len(g) > 1 else total)
        if kind == "absolute":
            return absolute(g)
        if len(g) == 1:
            return tok[g] / total if tok[g] else lm.UNSEEN
        if g == whole:
            return max(0, tok[g] - 0.75) / tok[g[:-1]] + count(after, g[:-1]) * 0.75 / tok[g[:-1]] * kn(g[1:])
        return kn(g)

    return p


@pytest.mark.parametrize("kind", ["mle", "absolute", "kneser_ney"])
def test_backed_off(spark, kind):
    rng = random.Random(7)
    lines = ["".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 25))) for _ in range(30)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(lines)], "doc_id long, text string, lang string")
    tok = ngrams.token_counts(ngrams.lines_of(docs), 4)
    asked = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 4))) for _ in range(400)})
    wanted = spark.createDataFrame([("x", g) for g in asked] + [("nowhere", "a")], "lang string, g string")
    got = {(r["lang"], r["g"]): r["p"] for r in lm.backed_off(wanted, tok, 4, kind).collect()}
    p = brute_backoff(lines, 4, kind)
    assert len(got) == len(asked) + 1 and math.isclose(got["nowhere", "a"], lm.UNSEEN)
    for g in asked:
        assert math.isclose(got["x", g], p(g), rel_tol=1e-12, abs_tol=1e-300), g
    if kind == "kneser_ney":
        own = lm.models_of(tok, 4, 1.0)["x"]
        assert all(math.isclose(own(g[:-1], g[-1]), p(g), rel_tol=1e-12) for g in asked)
        assert math.isclose(own("zzzzzza", "b"), p("zzab"))
    with pytest.raises(ValueError):
        lm.backed_off(wanted, tok, 4, "other")


def test_held_out_perplexity(spark):
    """A text that was never seen: what was learnt from other lines, character by character."""
    train, unseen = ["abab", "ba ab", "abba"], "aab"
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(train)], "doc_id long, text string, lang string")
    tok, p = ngrams.token_counts(ngrams.lines_of(docs), 3), brute_backoff(train, 3, "kneser_ney")
    lines = ngrams.lines_of(spark.createDataFrame([(9, unseen, "x")], "doc_id long, text string, lang string"))
    prob = lm.backed_off(ngrams.contexts(lines, 3, ("lang",)), tok, 3)
    got = lm.perplexity(lines, prob, 3).first()
    assert got["n_chars"] == 3 and math.isclose(got["perplexity"], math.exp(-sum(map(math.log, (p("a"), p("aa"), p("aab")))) / 3)) and got["perplexity"] < 10


FIRST = {("L1", "a"): 0.11, ("L1", "ab a"): 0.12, ("L1", "ab"): 0.13, ("L1", "b ab"): 0.14, ("L1", "ab "): 0.15, ("L1", " ab "): 0.16, ("L2", "x"): 0.21, ("L2", "xy"): 0.22, ("L2", "xy "): 0.23}


@pytest.mark.parametrize(("text", "langs", "want"), [("ab ", "111", 11.456984790348551), ("ab ab xy ab", "11111122211", 9.996534024760905)])
def test_perplexity_with_language_changes(spark, text, langs, want):
    """A four-character model of each of two languages, and what two texts score."""
    prob = spark.createDataFrame([(lang, g, p) for (lang, g), p in FIRST.items()], "lang string, g string, p double")
    prior = spark.createDataFrame([("L1", 0.31), ("L2", 0.5)], "lang string, prior double")
    move = spark.createDataFrame([("L1", "L1", 0.32), ("L1", "L2", 0.33), ("L2", "L2", 0.34), ("L2", "L1", 0.35)], "from_lang string, to_lang string, p double")
    parts = spark.createDataFrame([(1, k, f"L{n}", c) for k, (c, n) in enumerate(zip(text, langs, strict=True))], "doc_id long, at int, lang string, text string")
    runs = lm.runs_of(parts, "doc_id", "at")
    got = lm.run_perplexity(runs, prob, prior, move, {"L1": 4, "L2": 4}).first()
    assert got["n_chars"] == len(text) and math.isclose(got["perplexity"], want, rel_tol=1e-14)


def test_language_change_inside_a_word(spark):
    runs = spark.createDataFrame([(1, 1, "L1", "ab"), (1, 2, "L2", "x"), (2, 1, "L1", "ab ")], "doc_id long, run long, lang string, text string")
    prob = spark.createDataFrame([(lang, g, p) for (lang, g), p in FIRST.items()], "lang string, g string, p double")
    prior = spark.createDataFrame([("L1", 0.31), ("L2", 0.5)], "lang string, prior double")
    move = spark.createDataFrame([(a, b, 0.5) for a in ("L1", "L2") for b in ("L1", "L2")], "from_lang string, to_lang string, p double")
    got = {r["doc_id"]: r["perplexity"] for r in lm.run_perplexity(runs, prob, prior, move, 4).collect()}
    assert got[1] is None and got[2] > 1


def test_orders_of_languages(spark):
    runs = spark.createDataFrame([(1, 1, "L1", "abab"), (1, 2, "L2", "abab")], "doc_id long, run long, lang string, text string")
    got = {(r["lang"], r["g"]): r["k"] for r in lm.run_contexts(runs, {"L1": 3, "L2": 2}, "doc_id").collect()}
    assert got == {("L1", "a"): 1, ("L1", "ab"): 1, ("L1", "aba"): 1, ("L1", "bab"): 1, ("L2", "a"): 1, ("L2", "ab"): 2, ("L2", "ba"): 1}


def test_mixed_and_marginal(spark):
    docs = spark.createDataFrame([(1, "abab", "x"), (2, "aacc", "y")], "doc_id long, text string, lang string")
    tok = ngrams.token_counts(ngrams.lines_of(docs), 2)
    wanted = spark.createDataFrame([("x", "ab"), ("y", "ab"), ("x", "c")], "lang string, g string")
    two, one = lm.backed_off(wanted, tok, 2), lm.backed_off(wanted, tok, 2, "mle")
    a, b = ({(r["lang"], r["g"]): r["p"] for r in df.collect()} for df in (two, one))
    got = {(r["lang"], r["g"]): r["p"] for r in lm.mixed([(two, 3.0), (one, 1.0)]).collect()}
    assert all(math.isclose(got[k], 0.75 * a[k] + 0.25 * b[k]) for k in a)
    prior = spark.createDataFrame([("x", 0.25), ("y", 0.75)], "lang string, prior double")
    got = {r["g"]: r["p"] for r in lm.marginal(wanted.select("g"), tok, prior, 2).collect()}
    assert math.isclose(got["ab"], 0.25 * a["x", "ab"] + 0.75 * a["y", "ab"])
    with pytest.raises(ValueError):
        lm.mixed([])


def test_text_helpers(spark):
    frame = spark.createDataFrame([("abcd", "abxd"), ("", "a"), ("ab", "ab"), ("ab", "abc"), ("x", "y")], "a string, b string")
    assert [r[0] for r in frame.select(X.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 2, 0]
    assert [r[0] for r in frame.select(X.last(F.col("a"))).collect()] == ["d", None, "b", "b", "x"]
    assert frame.select(X.take(F.col("a"), -1), X.drop(F.col("a"), 9), X.take(F.col("a"), 9)).first() == ("", "", "abcd")
    lines = spark.createDataFrame([(["a-", "b ", " c"],), (["x", "-", "y"],), (["a-", "-", "b"],)], "x array<string>")
    assert [r[0] for r in lines.select(X.joined_lines(F.col("x"))).collect()] == [" ab c", " x y", " ab"]
    paths = spark.createDataFrame([("a/b.c.txt",), ("none",)], "p string")
    assert [tuple(r) for r in paths.select(X.extension(F.col("p")), X.without_extension(F.col("p"))).collect()] == [("txt", "a/b.c"), (None, "none")]
    assert X.lowest_common_path(["/a/b/c", "/a/b/d/e"]) == "/a/b" and X.remove_common_prefix("/a/b/c", "/a/x") == ("b/c", "x")
    assert X.path_relative_to("/a/b/c", "/a/x/y") == "../../b/c" and X.path_relative_to("/a/b", "/a") == "b"


def test_flipped_letters(spark):
    line = spark.createDataFrame([(1, "uv" * 500 + "UVx")], "k int, line string")
    for keep in (0.0, 0.3, 1.0):
        got = line.select(R.flip_uv(F.col("line"), keep, F.col("k"))).first()[0]
        same = sum(a == b for a, b in zip(got, "uv" * 500, strict=False))
        assert abs(same / 1000 - keep) < 0.05 and got[-1] == "x" and set(got) <= set("uvUVx")
