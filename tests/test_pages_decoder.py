import itertools
import math

import numpy as np

from glyphspark.operators import decoder as D
from glyphspark.operators import pages as P
from glyphspark.operators import training as T
from glyphspark.streaming import incremental


def _page(lines=4, width=240):
    levels = np.full((width, 40 * lines + 20), 255.0)
    rng = np.random.default_rng(1)
    for k in range(lines):
        top = 20 + 40 * k
        for x in range(10, width - 10, 8):
            levels[x : x + 4, top + (4 if rng.random() < 0.8 else 0) : top + 16] = 0
    return levels


def test_page_kernels():
    levels = _page()
    assert P.threshold(np.array([[0.0, 255.0]])) == 127.5
    turned = P.straighten(P.rotate(levels, 0.03))
    sharp = lambda p: np.abs(np.diff((255 - p).mean(axis=0))).sum()
    assert sharp(turned) > sharp(P.rotate(levels, 0.03))
    ink = np.zeros((6, 6), bool)
    ink[0, 0:3] = ink[4:6, 5] = True
    assert sorted(np.unique(P.components(ink), return_counts=True)[1].tolist()) == [2, 3, 31]
    assert (P.drop_components(np.where(ink, 0.0, 255.0), 3, 10, 127) == 0).sum() == 3
    found = P.baselines(P.vertical_profile(levels <= 127))
    assert len(found) in (3, 4, 5) and found == sorted(found)
    assert all(x.shape[1] == P.HEIGHT for x in P.cut_lines(levels))


def test_extract_lines(spark):
    levels = _page().astype(np.uint8)
    df = spark.createDataFrame([(7, levels.shape[0], levels.shape[1], bytearray(levels.tobytes()))], "doc_id long, width int, height int, levels binary")
    rows = P.extract_lines(df, do_crop=False).collect()
    assert rows and all(r["height"] == 30 and len(r["pixels"]) == r["width"] * 30 for r in rows)


def _weights(kind):
    w = np.full((D.COLUMNS, D.HEIGHT), -3.0)
    if kind == "a":
        w[:, 15:] = 3.0
    else:
        w[:15, :] = 3.0
    return w


def _font(widths=(3, 4)):
    return [D.Template("a", {w: math.log(0.5) for w in widths}, _weights("a")), D.Template("b", {w: math.log(0.5) for w in widths}, _weights("b")), D.Template(" ", {w: math.log(0.5) for w in widths})]


def _model(order=2):
    table = {("", "a"): 0.6, ("", "b"): 0.3, ("", " "): 0.1}
    prob = lambda context, c: table["", c] if not context else {"a": {"a": 0.1, "b": 0.7, " ": 0.2}, "b": {"a": 0.6, "b": 0.2, " ": 0.2}, " ": {"a": 0.5, "b": 0.5, " ": 0.0}}[context[-1]][c]
    return D.Transitions({"x": prob}, {"x": ["a", "b", " "]}, {"x": 1.0}, {("x", "x"): 1.0}, order)


def _line(text, width=4, pad=1):
    parts = []
    for c in text:
        w = next(t for t in _font() if t.char == c)
        parts.append((D.log_probs(w.weights, width, 0)[0] > math.log(0.5)).astype(np.uint8) if w.weights is not None else np.zeros((width, 30), np.uint8))
        parts.append(np.zeros((pad, 30), np.uint8))
    return np.concatenate(parts)


def test_beam_against_all_readings():
    em = D.Emission(_line("ab"), _font(), (1, 1), range(0, 1))
    model = _model()
    best = -math.inf

    def walk(state, at, score):
        nonlocal best
        for width, scores in em.best.get(state.glyph, {}).items():
            if at < scores.size and at + width <= em.length:
                total, end = score + scores[at], at + width
                if end == em.length:
                    best = max(best, total)
                for to, p in model.within(state):
                    walk(to, end, total + p)

    for state, p in model.start():
        walk(state, 0, p)
    lines, score = D.decode_lines([em], model, beam=10_000)
    assert math.isclose(score, best, rel_tol=1e-9)
    assert "".join(s.glyph for s, _, _ in lines[0] if s.type == "TMPL").strip() == "ab"
    narrow = D.decode_lines([em], model, beam=10)[1]
    assert narrow <= score + 1e-9


def test_emission_explains_its_best():
    em = D.Emission(_line("ba"), _font(), (1, 2))
    for char, width in itertools.product("ab", (4, 5, 6)):
        w, pad, e, o = em.explain(char, 0, width)
        assert w + pad == width and math.isclose(em.parts[char, w, pad, e * 100 + o][0], em.best[char][width][0])


def test_gradient_and_fit():
    rng = np.random.default_rng(0)
    prior = rng.normal(size=(D.COLUMNS, D.HEIGHT))
    counts = [(e, w, rng.integers(0, 9, (w, 30)).astype(float), rng.integers(0, 9, (w, 30)).astype(float)) for e, w in ((0, 4), (2, 7))]
    x = rng.normal(size=prior.size)
    value, grad = T.template_loss(x, counts, prior)
    for k in (0, 200, 899):
        step = np.zeros_like(x)
        step[k] = 1e-5
        assert math.isclose((T.template_loss(x + step, counts, prior)[0] - T.template_loss(x - step, counts, prior)[0]) / 2e-5, grad[k], rel_tol=1e-3, abs_tol=1e-4)
    assert T.template_loss(T.lbfgs(lambda w: T.template_loss(w, counts, prior), x, 50), counts, prior)[0] < value
    assert math.isclose(D.fit_widths(np.bincount([4, 4, 5, 5, 5, 6], minlength=20), 1, 12).sum(), 1.0)


def test_training_and_restart(spark, tmp_path):
    lines = spark.createDataFrame([(d, k, x.shape[0], 30, bytearray(x.tobytes())) for d in (1, 2) for k, x in enumerate([_line("ab a"), _line("ba")])], "doc_id long, line_no int, width int, height int, pixels binary")
    options = {"pad": (1, 1), "offsets": range(0, 1), "beam": 8}
    first = [*_font(), D.Template("-", {3: 0.0}, np.full((D.COLUMNS, D.HEIGHT), -3.0) + 6.0 * (np.arange(D.HEIGHT) == 15))]  # a line may end in a hyphen
    font = T.train(lines, first, _model(), str(tmp_path), 1, **options)
    assert T.last_round(spark, str(tmp_path)) == 1 and {t.char for t in font} == {"a", "b", " ", "-"}
    T.train(lines, first, _model(), str(tmp_path), 2, **options)
    assert T.last_round(spark, str(tmp_path)) == 2
    decoded = spark.read.parquet(f"{tmp_path}/decode/iter=2")
    text = "".join(r["glyph"] for r in decoded.where("doc_id = 1 and line_no = 1 and type = 'TMPL'").orderBy("pos").collect())
    assert text.strip() == "ba"
    assert T.joint_log_prob(decoded).first()[0] < 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "ab\nab", "x")], "doc_id long, text string, lang string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string, lang string").parquet(source)
    incremental.ngram_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([(2, "ab", "x")], "doc_id long, text string, lang string").write.mode("append").parquet(source)
    incremental.ngram_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["g"]: r["t"] for r in incremental.counts_so_far(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": 3, "b": 3, "ab": 3}
