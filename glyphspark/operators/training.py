"""Training of templates by hard EM: counts from decoded lines, and an L-BFGS step for each character."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.operators import gsm, lm, transcript, versions
from glyphspark.operators.decoder import COLUMNS, GAINS, GlyphModel, Template, Transitions, decode, fit_widths, kernel
from glyphspark.operators.pages import BLACK, HEIGHT, WHITE

REGULARIZER = 0.01


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 20, tol: float = 1e-5, memory: int = 6) -> np.ndarray:
    """Minimise a function that gives value and gradient: limited-memory BFGS with backtracking."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            q += (a - rho * (y @ q)) * s
        step, slope = 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12)), -(grad @ q)
        while step > 1e-12:
            new = x - step * q
            value_new, grad_new = f(new)
            if value_new <= value + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            return x
        s, y = new - x, grad_new - grad
        if s @ y > 1e-12:
            past = [*past, (s, y, 1.0 / (s @ y))][-memory:]
        small = abs(value - value_new) <= tol * max(1.0, abs(value))
        x, value, grad = new, value_new, grad_new
        if small:
            break
    return x


def template_loss(weights: np.ndarray, counts: list[tuple[int, int, np.ndarray, np.ndarray]], prior: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative expected log-likelihood and a pull to the prior, with the gradient. Counts: (exposure, width, black, white)."""
    w = weights.reshape(COLUMNS, HEIGHT)
    value, grad = REGULARIZER * ((w - prior) ** 2).sum(), 2 * REGULARIZER * (w - prior)
    for e, width, black, white in counts:
        k = kernel(width)
        x = GAINS[e] * (k @ w)
        p = 1 / (1 + np.exp(-x))
        value += (black * np.logaddexp(0, -x) + white * np.logaddexp(0, x)).sum()
        grad += GAINS[e] * (k.T @ (p * (black + white) - black))
    return float(value), grad.reshape(-1)


def emission_counts(decoded: DataFrame, lines: DataFrame) -> DataFrame:
    """(char, exposure, width, black, white): pixels of decoded glyphs added up, rows moved by the offset and clamped.

    Each task adds up what it has first, so a frequent glyph reaches its group as a few rows.
    """
    schema = "char string, exposure int, width int, n long, black binary, white binary"
    shown = decoded.where("type = 'TMPL' and char_w > 0").select("doc_id", "line_no", F.struct("x", "glyph", "char_w", "exposure", "v_offset").alias("s"))
    joined = lines.join(shown.groupBy("doc_id", "line_no").agg(F.collect_list("s").alias("s")), ["doc_id", "line_no"])

    def partial(frames):
        sums: dict[tuple, list] = {}
        for frame in frames:
            for r in frame.itertuples():
                px = np.frombuffer(r.pixels, np.uint8).reshape(r.width, r.height)
                for g in r.s:
                    rows = np.clip(np.arange(HEIGHT) + g["v_offset"], 0, HEIGHT - 1)
                    cut = px[g["x"] : g["x"] + g["char_w"]][:, rows]
                    own = sums.setdefault((g["glyph"], g["exposure"], g["char_w"]), [0, 0.0, 0.0])
                    own[0] += 1
                    own[1] = own[1] + (cut == BLACK)
                    own[2] = own[2] + (cut == WHITE)
        yield pd.DataFrame([(*k, n, np.asarray(b, float).tobytes(), np.asarray(w, float).tobytes()) for k, (n, b, w) in sums.items()], columns=["char", "exposure", "width", "n", "black", "white"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        black, white = (sum(np.frombuffer(x) for x in frame[c]) for c in ("black", "white"))
        first = frame.iloc[0]
        return pd.DataFrame([(first["char"], first["exposure"], first["width"], frame["n"].sum(), black.tobytes(), white.tobytes())], columns=["char", "exposure", "width", "n", "black", "white"])

    return joined.mapInPandas(partial, schema).groupBy("char", "exposure", "width").applyInPandas(total, schema)


def fit_templates(counts: DataFrame, font: list[Template], rounds: int = 20) -> list[Template]:
    """New templates: weights by L-BFGS and widths from counts, characters side by side; those not seen stay as they are.

    A font (some hundred templates of fixed size) comes back to the driver.
    """
    old = {t.char: t for t in font if t.weights is not None}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        char = frame["char"].iloc[0]
        if char not in old:
            return pd.DataFrame([], columns=["char", "weights", "widths"])
        prior, own = old[char].weights, []
        for r in frame.itertuples():
            own.append((r.exposure, r.width, np.frombuffer(r.black).reshape(r.width, HEIGHT), np.frombuffer(r.white).reshape(r.width, HEIGHT)))
        new = lbfgs(lambda w: template_loss(w, own, prior), prior.reshape(-1).copy(), rounds)
        low, high = min(old[char].widths), max(old[char].widths)
        by_width = np.zeros(high + 1)
        for r in frame.itertuples():
            by_width[min(r.width, high)] += r.n
        return pd.DataFrame([(char, new.tobytes(), fit_widths(by_width, low, high).tobytes())], columns=["char", "weights", "widths"])

    rows = {r["char"]: r for r in counts.groupBy("char").applyInPandas(fit, "char string, weights binary, widths binary").collect()}
    out = []
    for t in font:
        if t.char in rows:
            p = np.frombuffer(rows[t.char]["widths"])
            low = min(t.widths)
            out.append(Template(t.char, {low + k: float(np.log(x)) for k, x in enumerate(p) if x > 0}, np.frombuffer(rows[t.char]["weights"]).reshape(COLUMNS, HEIGHT)))
        else:
            out.append(t)
    return out


def font_frame(spark: SparkSession, font: list[Template]) -> DataFrame:
    rows = [(t.char, None if t.weights is None else t.weights.tobytes(), {int(k): float(v) for k, v in t.widths.items()}) for t in font]
    return spark.createDataFrame(rows, "char string, weights binary, widths map<int,double>")


def font_of(frame: DataFrame) -> list[Template]:
    return [Template(r["char"], dict(r["widths"]), None if r["weights"] is None else np.frombuffer(bytes(r["weights"])).reshape(COLUMNS, HEIGHT)) for r in frame.orderBy("char").collect()]


@dataclass
class Models:
    """All that decoding needs: templates, language models with priors, characters, and glyph substitution if there is any."""

    font: list[Template]
    languages: dict[str, Any]
    priors: dict[str, float]
    chars: dict[str, list[str]]
    keep: float = 0.999999
    order: int = 6
    glyphs: GlyphModel | None = None
    switch_on_punctuation: bool = True
    offsets: range | None = None

    def transitions(self) -> Transitions:
        return Transitions(self.languages, self.chars, self.priors, lm.switch_table(self.priors, self.keep), self.order, self.glyphs, self.switch_on_punctuation, self.offsets)


@dataclass(frozen=True)
class Updates:
    """What an M-step updates, after how many documents (0: all), and how."""

    font: bool = True
    language: bool = False
    glyphs: bool = False
    batch_docs: int = 0
    new_text: float = 0.5
    smoothing: float = 1.0
    elision: float = 100.0


def m_step(models: Models, decoded: DataFrame, lines: DataFrame, updates: Updates, store: str | None = None) -> Models:
    """Models re-estimated from one batch's decode table; counts of earlier batches don't linger. New language models are stored at ``store``."""
    if updates.font:
        models = replace(models, font=fit_templates(emission_counts(decoded, lines), models.font))
    if updates.language:
        texts = transcript.language_runs(decoded).select("lang", F.col("text").alias("line"))
        power = next(iter(models.languages.values()))
        power = (power.parts[0][0] if isinstance(power, lm.Mixture) else power).power
        languages, priors = lm.reestimated(models.languages, texts, models.order, power, updates.new_text, store)
        models = replace(models, languages=languages, priors=priors)
    if updates.glyphs and models.glyphs is not None:
        active = decoded.sparkSession.createDataFrame([(lang, c) for lang, own in models.chars.items() for c in own], "lang string, char string")
        counts = gsm.smoothed(gsm.glyph_counts(decoded), gsm.smoothing_grid(active, updates.smoothing, updates.elision))
        old = models.glyphs
        models = replace(models, glyphs=GlyphModel.of(gsm.probabilities(counts), active, elide_anything=old.elide_anything, no_sub=old.no_sub, power=old.power))
    return models


def train_models(lines: DataFrame, models: Models, path: str, rounds: int = 3, updates: Updates = Updates(), **options: Any) -> Models:  # noqa: B008
    """Hard EM in mini-batches of documents: decode a batch, re-estimate what ``updates`` says, go on with the new models.

    Documents are numbered by id; a short remainder joins the last batch. Lines are laid out by batch once. Each batch ends with a
    version of all models (``versions``) next to its decode table; a run that is started again goes on behind the last whole one.
    """
    if rounds <= 0:
        raise ValueError("rounds must be positive")
    spark = lines.sparkSession
    lines, batches = versions.laid_out(lines, path, updates.batch_docs)
    steps = [(k, b) for k in range(1, rounds + 1) for b in range(1, batches + 1)]
    place = lambda what, k, b: f"{path}/{what}/iter={k}/batch={b}"
    done = 0
    while done < len(steps) and versions.exists(spark, place("models", *steps[done])):
        done += 1
    if done:
        models = versions.load(spark, place("models", *steps[done - 1]))
    for k, b in steps[done:]:
        own = lines.where(F.col("batch_no") == b).drop("batch_no")  # read by folder
        decode(own, models.font, models.transitions(), **options).write.mode("overwrite").parquet(place("decode", k, b))
        version = place("models", k, b)
        models = m_step(models, spark.read.parquet(place("decode", k, b)), own, updates, f"{version}/languages")
        versions.save(spark, models, version)
    return models


def train(lines: DataFrame, font: list[Template], model: Transitions, path: str, rounds: int = 3, **options: Any) -> list[Template]:
    """Hard EM of the templates alone: decode, count, refit; each round's decode table and font are written below ``path`` and read again."""
    if rounds <= 0:
        raise ValueError("rounds must be positive")
    spark = lines.sparkSession
    done = last_round(spark, path)
    if done:
        font = font_of(spark.read.parquet(f"{path}/font/iter={done}"))
    for k in range(done + 1, rounds + 1):
        decode(lines, font, model, **options).write.mode("overwrite").parquet(f"{path}/decode/iter={k}")
        font = fit_templates(emission_counts(spark.read.parquet(f"{path}/decode/iter={k}"), lines), font)
        font_frame(spark, font).write.mode("overwrite").parquet(f"{path}/font/iter={k}")
    return font


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def last_round(spark: SparkSession, path: str) -> int:
    """The last round whose font was written whole, 0 if none: where training goes on."""
    jvm = spark.sparkContext._jvm
    folder, fs = _folder(spark, f"{path}/font")
    if not fs.exists(folder):
        return 0
    whole = [s.getPath() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max([int(p.getName().split("=")[1]) for p in whole], default=0)


def joint_log_prob(decoded: DataFrame) -> DataFrame:
    """(log_prob): mean over documents of the mean over their batches."""
    batches = decoded.groupBy("doc_id", "batch").agg(F.max("log_prob").alias("log_prob"))  # one value a batch
    return batches.groupBy("doc_id").agg(F.avg("log_prob").alias("p")).agg(F.avg("p").alias("log_prob"))
