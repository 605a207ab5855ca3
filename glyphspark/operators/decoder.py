"""Lines to decoded states: templates, emission scores, transitions and a semi-Markov beam search.

Given models, every batch of lines of a document is decoded by itself, so the Spark operator is one grouped map; lines
of a batch follow each other in one search.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.functions import charset
from glyphspark.operators.gsm import SPECIAL
from glyphspark.operators.pages import BLACK, HEIGHT, WHITE

COLUMNS, EXPOSURES, GAINS, OFFSETS = 30, 3, (1.0, 0.5, 0.25), range(-5, 6)  # fixed values
SPACE_BLACK = (0.05, 0.02, 0.1)
KERNEL_STD, MARGIN_PROB, HYPHEN_PROB = 1.5, 0.5, 1e-8


def kernel(width: int) -> np.ndarray:
    """Weights (width x template columns) that spread a template over a width: Gaussian bumps around each column's place."""
    interval = COLUMNS / width
    centre = (np.arange(width) + 0.5) * interval - 0.5
    w = np.exp(-0.5 * ((np.arange(COLUMNS)[None, :] - centre[:, None]) / (KERNEL_STD * interval)) ** 2)
    return w / w.sum(axis=1, keepdims=True)


def log_probs(weights: np.ndarray, width: int, exposure: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of black and white (width x height) of a template (columns x height)."""
    x = GAINS[exposure] * (kernel(width) @ weights)
    return -np.logaddexp(0, -x), -np.logaddexp(0, x)


def space_log_probs(width: int, exposure: int) -> tuple[np.ndarray, np.ndarray]:
    p = SPACE_BLACK[exposure]
    return np.full((width, HEIGHT), math.log(p)), np.full((width, HEIGHT), math.log(1 - p))


def fit_widths(counts: np.ndarray, low: int, high: int) -> np.ndarray:
    """Width distribution over low..high from counts by width: a Gaussian, cut off beyond 2.5 deviations, variance 0.01 at least."""
    widths = np.arange(low, high + 1)
    total = max(counts[low : high + 1].sum(), 1e-9)
    mean = (widths * counts[low : high + 1]).sum() / total
    var = max((counts[low : high + 1] * (widths - mean) ** 2).sum() / total, 1e-2)
    p = np.where(np.abs(widths - mean) < 2.5 * math.sqrt(var), np.exp(-0.5 * (widths - mean) ** 2 / var), 0.0)
    if not p.sum():
        p[np.abs(widths - mean).argmin()] = 1.0
    return p / p.sum()


@dataclass
class Template:
    """A character's look: weights (columns x height), or None for a space, and log-probabilities of its widths."""

    char: str
    widths: dict[int, float]
    weights: np.ndarray | None = None

    def log_probs(self, width: int, exposure: int) -> tuple[np.ndarray, np.ndarray]:
        return space_log_probs(width, exposure) if self.weights is None else log_probs(self.weights, width, exposure)


class Emission:
    """Best scores of a template at every place of a line, over exposures, vertical offsets and padding.

    ``best[char][width]`` scores a span of ``width`` columns (template and padding) from each column on; what attained it is found
    again by ``explain``.
    """

    def __init__(self, line: np.ndarray, font: list[Template], pad: tuple[int, int] = (1, 5), offsets: range = OFFSETS, by_offset: bool = False):
        self.font, self.pads, self.offsets = {t.char: t for t in font}, range(pad[0], pad[1] + 1), offsets
        black, white = (line == BLACK).astype(float), (line == WHITE).astype(float)
        shifted = {o: (self._shift(black, o), self._shift(white, o)) for o in offsets}
        self.length = line.shape[0]
        clear = [self._cumulative(black * math.log(p) + white * math.log(1 - p)) for p in SPACE_BLACK]
        self.parts: dict[tuple[str, int, int, int], np.ndarray] = {}
        self.best: dict[str, dict[int, np.ndarray]] = {}
        self.at: dict[tuple[str, int], dict[int, np.ndarray]] = {}  # the best of each offset, if asked for
        for t in font:
            own: dict[int, np.ndarray] = {}
            for w, log_width in t.widths.items():
                n = self.length - w + 1
                for e in range(EXPOSURES) if n > 0 else ():
                    lb, lw = t.log_probs(w, e)
                    for o in offsets if t.weights is not None else (0,):
                        b, v = shifted[o]
                        part = sum(b[k : k + n] @ lb[k] + v[k : k + n] @ lw[k] for k in range(w)) + log_width
                        for pad in self.pads:
                            m = n - pad
                            if m > 0:
                                # the glyph's exposure holds for its padding, which stands behind it
                                total = part[:m] + (clear[e][w + pad : w + pad + m] - clear[e][w : w + m]) - math.log(len(self.pads))
                                self.parts[t.char, w, pad, e * 100 + o] = total
                                own[w + pad] = np.maximum(own[w + pad], total) if w + pad in own else total.copy()
                                for k in (offsets if t.weights is None else (o,)) if by_offset else ():
                                    one = self.at.setdefault((t.char, k), {})
                                    one[w + pad] = np.maximum(one[w + pad], total) if w + pad in one else total.copy()
            self.best[t.char] = own

    @staticmethod
    def _shift(x: np.ndarray, offset: int) -> np.ndarray:
        rows = np.clip(np.arange(HEIGHT) + offset, 0, HEIGHT - 1)
        return x[:, rows]

    @staticmethod
    def _cumulative(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(x.sum(axis=1))])

    def scores(self, char: str, offset: int | None = None) -> dict[int, np.ndarray]:
        """Scores by width of a template, at any offset or at one."""
        return self.best.get(char, {}) if offset is None else self.at.get((char, offset), {})

    def explain(self, char: str, at: int, width: int, offset: int | None = None) -> tuple[int, int, int, int]:
        """(template width, padding, exposure, offset) of the best reading of a span."""
        fixed = offset is not None and self.font[char].weights is not None
        found = [(v[at], -k[3] // 100, k) for k, v in self.parts.items() if k[0] == char and k[1] + k[2] == width and at < v.size and not (fixed and k[3] - 100 * round(k[3] / 100) != offset)]
        _, w, pad, code = max(found, key=lambda x: (x[0], x[1]))[2]
        e = round(code / 100)
        return w, pad, e, code - e * 100


@dataclass(frozen=True)
class State:
    """A step of reading: type of place, context of the language model, language, the glyph that is shown, and its vertical offset if that is modelled."""

    type: str
    context: str = ""
    lang: str | None = None
    glyph: str = " "
    glyph_type: str = "NORMAL_CHAR"
    offset: int | None = None

    @property
    def lm_char(self) -> str:
        if self.type == "RMRGN_HPHN_INIT":
            return "-"
        return self.context[-1] if self.type == "TMPL" and self.context else " "


HYPHENATED = ("RMRGN_HPHN_INIT", "RMRGN_HPHN", "LMRGN_HPHN")
ELIDED = ("TILDE_ELIDED", "FIRST_ELIDED", "ELIDED")


class GlyphModel:
    """Which glyphs may show a character, and how likely: ``probs`` are shares by (language, character, glyph or type of glyph).

    A character may show itself, a letter that is active in the language if it can be replaced, a long s for an s, its form with
    a tilde (then what follows is elided, as long as it can be), its bare vowel, nothing at the start of a word, or
    itself twice; with ``elide_anything`` letters may be left out everywhere instead of at the start of words.
    """

    def __init__(self, probs: dict[tuple[str, str, str], float], active: dict[str, list[str]], elide_anything: bool = False, no_sub: float = 0.9, power: float = 4.0):
        self.probs, self.active, self.elide_anything, self.no_sub, self.power = probs, active, elide_anything, no_sub, power
        self.letters = {lang: [c for c in chars if c in charset.LETTERS] for lang, chars in active.items()}

    @classmethod
    def of(cls, probs: DataFrame, active: DataFrame, **options: Any) -> GlyphModel:
        """From tables (lang, lm_char, glyph, p) and (lang, char): a language's glyphs are its active ones, and the special types.

        Both are as small as alphabets and come to the driver.
        """
        known = active.select("lang", F.col("char").alias("glyph"))
        own = probs.where(~F.col("glyph").isin(SPECIAL)).join(F.broadcast(known), ["lang", "glyph"], "left_semi")
        rest = probs.where(F.col("glyph").isin(*SPECIAL, " ", "ſ"))
        rows = own.select("lang", "lm_char", "glyph", "p").union(rest.select("lang", "lm_char", "glyph", "p")).distinct().collect()
        chars: dict[str, list[str]] = {}
        for r in active.orderBy("lang", "char").collect():
            chars.setdefault(r["lang"], []).append(r["char"])
        return cls({(r["lang"], r["lm_char"], r["glyph"]): r["p"] for r in rows}, chars, **options)

    def log_prob(self, lang: str | None, char: str, glyph: str, kind: str) -> float:
        """Score of a glyph: the powered share, mixed with a prior for showing the character itself. Before any language there are only spaces."""
        same = glyph == char and kind == "NORMAL_CHAR"
        if lang is None:
            return 0.0 if same and char == " " else -math.inf
        p = (1 - self.no_sub) * self.probs.get((lang, char, glyph if kind == "NORMAL_CHAR" else kind), 0.0) ** self.power + self.no_sub * same
        return math.log(p) if p > 0 else -math.inf

    def choices(self, before: State, lang: str, char: str) -> list[tuple[str, str]]:
        """(glyph, type) that may follow a state and show a character."""
        elidable = char in charset.LETTERS
        if before.glyph_type == "ELISION_TILDE":
            return [(" ", "TILDE_ELIDED")] if elidable else []
        out = [(char, "NORMAL_CHAR")]
        if char in charset.REPLACEABLE:
            out += [(c, "NORMAL_CHAR") for c in self.letters[lang] if c != char]
        if char == "s":
            out.append(("ſ", "NORMAL_CHAR"))
        if tilde := charset.tilde_form(char):
            out.append((tilde, "ELISION_TILDE"))
        if bare := charset.accent_dropped(char):
            out.append((bare, "NORMAL_CHAR"))
        if elidable:
            if before.glyph_type == "TILDE_ELIDED":
                out.append((" ", "TILDE_ELIDED"))
            if self.elide_anything:
                out.append((" ", "ELIDED"))
            elif before.lm_char == " " and before.type not in HYPHENATED and before.glyph_type != "FIRST_ELIDED":
                out.append((" ", "FIRST_ELIDED"))
            out += [(c, "DOUBLED") for c in ([char, "ſ"] if char == "s" else [char])]
        return list(dict.fromkeys(out))


def offset_steps(offsets: range, most: int = 2, var: float = 0.05) -> dict[int, dict[int, float]]:
    """Log-probabilities of the next glyph's vertical offset, ``most`` rows away at most; scaled over the offset that is left."""
    weight = {(a, b): math.exp(-((a - b) ** 2) / (2 * var)) for a in offsets for b in offsets if abs(a - b) <= most}
    total = {b: sum(w for (_, y), w in weight.items() if y == b) for b in offsets}
    return {a: {b: math.log(weight[a, b] / total[b]) for b in offsets if (a, b) in weight} for a in offsets}


@dataclass
class Transitions:
    """Which states follow which, with log-probabilities: several languages, margins, hyphens, glyph substitution, vertical offsets.

    ``probs[lang](context, char)`` are language models, ``chars[lang]`` their characters, ``switch`` the probabilities of a language
    after another. ``glyphs`` says what may show a character, itself only if there is none. With ``offsets`` every glyph has
    a vertical offset near that of the one before (one language without substitution).
    """

    probs: dict[str, Callable[[str, str], float]]
    chars: dict[str, list[str]]
    priors: dict[str, float]
    switch: dict[tuple[str, str], float]
    order: int = 3
    glyphs: GlyphModel | None = None
    switch_on_punctuation: bool = True
    offsets: range | None = None
    _known: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.offsets is not None and (len(self.probs) > 1 or self.glyphs is not None):
            raise ValueError("offsets are modelled for one language without substitution")
        self._punctuation = {c for own in self.chars.values() for c in own if c != " " and charset.is_punctuation(c)}
        self._steps = offset_steps(self.offsets) if self.offsets is not None else {}

    def prob(self, lang: str | None, context: str, char: str) -> float:
        """Of a character after a context; without a language, over all by their priors."""
        context = context[len(context) - self.order + 1 :] if len(context) >= self.order else context
        if lang is not None:
            return self.probs[lang](context, char)
        return sum(p * self.probs[x](context, char) for x, p in self.priors.items() if char in self.chars[x])

    def shown(self) -> set[str]:
        """All glyphs that states of this model may show."""
        out = {c for own in self.chars.values() for c in own} | {" ", "-"}
        if self.glyphs is not None:
            for own in self.chars.values():
                for c in own:
                    out |= {g for g in (charset.tilde_form(c), charset.accent_dropped(c), "ſ" if c == "s" else None) if g}
        return out

    def _context(self, context: str) -> str:
        """What a state keeps: the last character, and as many as the models look back."""
        return context[-max(self.order - 1, 1) :]

    def _placed(self, state: State, score: float, before: State | None) -> list[tuple[State, float]]:
        """A state with every offset it may have; margins other than a hyphen have none."""
        if score == -math.inf:
            return []
        if self.offsets is None:
            return [(state, score)]
        if state.type not in ("TMPL", "RMRGN_HPHN_INIT"):
            return [(replace(state, offset=0), score)]
        steps = self._steps[before.offset] if before is not None and before.type == "TMPL" and before.offset is not None else dict.fromkeys(self.offsets, 0.0)
        return [(replace(state, offset=o), score + p) for o, p in steps.items()]

    def _plain(self, type: str, context: str, lang: str | None, score: float, before: State | None) -> list[tuple[State, float]]:
        """A state that shows its character as it is; at a hyphen the kind of glyph before goes on, and the hyphen may be left out."""
        kind = before.glyph_type if before is not None else "NORMAL_CHAR"
        state = State(type, self._context(context), lang)
        if self.glyphs is None:
            return self._placed(replace(state, glyph=state.lm_char), score, before)
        if lang is None and type == "TMPL":
            return []
        if type in HYPHENATED:
            shown = [state.lm_char, " "] if type == "RMRGN_HPHN_INIT" else [state.lm_char]
            return [x for g in shown for x in self._placed(replace(state, glyph=g, glyph_type=kind), score + self.glyphs.log_prob(lang, state.lm_char, g, kind), before)]
        if kind == "ELISION_TILDE":
            return []
        return self._placed(replace(state, glyph=state.lm_char), score + self.glyphs.log_prob(lang, state.lm_char, state.lm_char, "NORMAL_CHAR"), before)

    def _glyphs(self, char: str, context: str, lang: str, score: float, before: State) -> list[tuple[State, float]]:
        state = State("TMPL", self._context(context), lang, char)
        if self.glyphs is None:
            return self._placed(state, score, before)
        return [x for g, kind in self.glyphs.choices(before, lang, char) for x in self._placed(replace(state, glyph=g, glyph_type=kind), score + self.glyphs.log_prob(lang, char, g, kind), before)]

    def _letters(self, before: State, context: str, score: float = 0.0, fresh: bool = False, word: bool = False) -> list[tuple[State, float]]:
        """Characters after a context; ``fresh`` forgets it in what follows, inside a hyphenated ``word`` no space or mark comes."""
        if before.glyph_type == "DOUBLED":
            return self._second(before, score)
        score += math.log(1 - MARGIN_PROB)
        made = lambda c: c if fresh else context + c
        out: list[tuple[State, float]] = []
        lang = before.lang
        between = lang is None or before.lm_char == " "
        langs = [lang] if lang is not None and (word or not between) else list(self.probs)
        for to in langs:
            share = 1.0 if word and lang is not None or not between else self.priors[to] if lang is None else self.switch[lang, to]
            for char in self.chars[to]:
                if char == " " or word and char in self._punctuation:
                    continue
                p = self.prob(to, context, char)
                plain = lang is not None and between and not word and char in self._punctuation
                if plain and not self.switch_on_punctuation:
                    if to != lang:
                        continue
                    p_lang = 1.0
                else:
                    p_lang = share
                if p > 0 and p_lang > 0:
                    total = score + math.log(p) + math.log(p_lang)
                    out += self._plain("TMPL", made(char), to, total, before) if plain else self._glyphs(char, made(char), to, total, before)
        if not word:  # a space never changes the language
            p = self.prob(lang, context, " ") if lang is None or " " in self.chars[lang] else 0.0
            if p > 0:
                out += self._plain("TMPL", made(" "), lang, score + math.log(p), before)
        return out

    def _second(self, s: State, score: float) -> list[tuple[State, float]]:
        """The second glyph of a doubled character, without another charge of the language model."""
        char = s.context[-1]
        shown = [char, "ſ"] if char == "s" else [char]
        return [x for g in shown for x in self._placed(State("TMPL", s.context, s.lang, g), score + (self.glyphs.log_prob(s.lang, char, g, "NORMAL_CHAR") if self.glyphs else 0.0), s)]

    def start(self) -> list[tuple[State, float]]:
        nothing = State("LMRGN")
        return self._plain("LMRGN", "", None, math.log(MARGIN_PROB), None) + self._letters(nothing, "")

    def within(self, s: State) -> list[tuple[State, float]]:
        if s not in self._known:
            self._known[s] = self._within(s)
        return self._known[s]

    def _within(self, s: State) -> list[tuple[State, float]]:
        margin = math.log(MARGIN_PROB)
        if s.type == "LMRGN":
            return self._plain("LMRGN", s.context, s.lang, margin, s) + self._letters(s, s.context)
        if s.type == "LMRGN_HPHN":
            return self._plain("LMRGN_HPHN", s.context, s.lang, margin, s) + (self._letters(s, s.context, word=True) if s.lang is not None else [])
        if s.type == "RMRGN":
            return self._plain("RMRGN", s.context, s.lang, margin, s)
        if s.type in ("RMRGN_HPHN", "RMRGN_HPHN_INIT"):
            return self._plain("RMRGN_HPHN", s.context, s.lang, margin, s)
        space = self.prob(s.lang, s.context, " ")
        out = self._plain("RMRGN", s.context + " ", s.lang, margin + math.log(1 - HYPHEN_PROB) + math.log(space), s) if space > 0 else []
        return out + self._plain("RMRGN_HPHN_INIT", s.context, s.lang, margin + math.log(HYPHEN_PROB), s) + self._letters(s, s.context)

    def next_line(self, s: State) -> list[tuple[State, float]]:
        margin = math.log(MARGIN_PROB)
        if s.type == "TMPL":  # the line's end is a space
            space = self.prob(s.lang, s.context, " ")
            if space <= 0:
                return []
            context = s.context + " "
            return self._plain("LMRGN", context, s.lang, margin + math.log(space), s) + self._letters(s, context, math.log(space))
        if s.type == "RMRGN":
            return self._plain("LMRGN", s.context, s.lang, margin, s) + self._letters(s, s.context)
        if s.type in ("RMRGN_HPHN", "RMRGN_HPHN_INIT"):
            return self._plain("LMRGN_HPHN", s.context, s.lang, margin, s) + (self._letters(s, s.context, word=True) if s.lang is not None else [])
        return self._plain("LMRGN", "", s.lang, margin, s) + self._letters(s, s.context, fresh=True)

    def may_end(self, s: State) -> bool:
        return s.glyph_type not in ("DOUBLED", "ELISION_TILDE")

    def pairs(self) -> tuple[list[str], np.ndarray]:
        """Characters and log-probabilities of each after each, over all languages: what a look ahead is worth, roughly.

        After a space the logarithms are scaled by 0.99 and a second space gets 0.01 more: fixed values.
        """
        chars = sorted({c for own in self.chars.values() for c in own})
        table = np.full((len(chars), len(chars)), -np.inf)
        for i, a in enumerate(chars):
            for j, b in enumerate(chars):
                p = self.prob(None, a, b)
                table[i, j] = math.log(p) if p > 0 else -np.inf
        if " " in chars:
            k = chars.index(" ")
            table[k] *= 1 - 0.01
            table[k, k] += 0.01
        return chars, table


def look_ahead(em: Emission, chars: list[str], pairs: np.ndarray) -> np.ndarray:
    """(columns + 1) x characters: the best that can follow after a character that ends at a column, in a bigram model without margins."""
    widths = sorted({w for c in chars for w in em.best.get(c, {})})
    spans = np.full((len(widths), em.length + 1, len(chars)), -np.inf)
    for j, c in enumerate(chars):
        for k, w in enumerate(widths):
            if (own := em.best.get(c, {}).get(w)) is not None:
                spans[k, : own.size, j] = own
    beta = np.full((em.length + 1, len(chars)), -np.inf)
    beta[em.length] = 0.0
    for t in range(em.length - 1, -1, -1):
        fit = [k for k, w in enumerate(widths) if t + w <= em.length]
        if fit:
            ahead = np.max(spans[fit, t] + beta[[t + widths[k] for k in fit]], axis=0)
            beta[t] = np.max(pairs + ahead[None, :], axis=1)
    return beta


def decode_lines(emissions: list[Emission], model: Transitions, beam: int = 10, ahead: bool = True) -> tuple[list[list[tuple[State, int, int]]], float]:
    """Best states (state, first column, width) of each line, and the log-probability of all; ``beam`` states stay at each column.

    Which states stay is decided by their score and, with ``ahead``, what can follow them (``look_ahead``). A line without any
    reading is empty, and the next one starts afresh.
    """
    ends: dict[State, tuple[float, tuple | None]] = {}
    done: list[list[tuple[State, int, int]]] = []
    chars, pairs = model.pairs() if ahead else ([], np.zeros((0, 0)))
    column = {c: k for k, c in enumerate(chars)}
    for number, em in enumerate(emissions):
        reach: list[dict[State, tuple[float, tuple | None]]] = [{} for _ in range(em.length + 1)]
        beta = look_ahead(em, chars, pairs) if ahead else None

        def place(state: State, score: float, at: int, trail: tuple | None, em: Emission = em, reach: list = reach, number: int = number) -> None:
            if state.type == "TMPL" and state.glyph_type in ELIDED:  # shows nothing: no width
                if state not in reach[at] or reach[at][state][0] < score:
                    reach[at][state] = (score, (trail, number, state, at, 0))
                return
            for width, scores in em.scores(state.glyph, state.offset).items():
                if at < scores.size and at + width <= em.length:
                    total = score + scores[at]
                    old = reach[at + width].get(state)
                    if total > -math.inf and (old is None or old[0] < total):
                        reach[at + width][state] = (total, (trail, number, state, at, width))

        def order(item: tuple, at: int, beta: np.ndarray | None = beta) -> float:
            state, (score, _) = item
            if beta is None:
                return -score
            hope = beta[at, column[state.glyph]] if state.glyph in column else beta[at].max()
            return -(score + max(hope, -1e300))

        first = [(t, s + p, trail) for state, (s, trail) in ends.items() for t, p in model.next_line(state)] if ends else [(t, p, None) for t, p in model.start()]
        for state, score, trail in first:
            place(state, score, 0, trail)
        for at in range(em.length):
            seen: set[State] = set()
            while fresh := [x for x in sorted(reach[at].items(), key=lambda x: order(x, at))[:beam] if x[0] not in seen]:  # noqa: B023
                for state, (score, trail) in fresh:
                    seen.add(state)
                    for to, p in model.within(state):
                        place(to, score + p, at, trail)
                if not any(x[0] not in seen for x in reach[at].items()):
                    break
        last = {s: v for s, v in reach[em.length].items() if model.may_end(s)}
        ends = dict(sorted(last.items(), key=lambda x: -x[1][0])[:beam])
        if not ends:
            done.append([])
    if not ends:
        return [[] for _ in emissions], -math.inf
    score, trail = max(ends.values(), key=lambda x: x[0])
    lines: list[list[tuple[State, int, int]]] = [[] for _ in emissions]
    while trail is not None:
        trail, number, state, at, width = trail
        lines[number].append((state, at, width))
    return [x[::-1] for x in lines], score


def check_font(font: list[Template], model: Transitions) -> None:
    """An error if a glyph that the model may show has no template."""
    missing = model.shown() - {t.char for t in font}
    if missing:
        raise ValueError(f"no templates for {sorted(missing)}")


def decode(lines: DataFrame, font: list[Template], model: Transitions, beam: int = 10, batch: int = 32, pad: tuple[int, int] = (1, 5), offsets: range = OFFSETS, ahead: bool = True) -> DataFrame:
    """The decode table of line images (doc_id, line_no, width, height, pixels): one group for each document and batch of lines."""
    schema = "doc_id long, line_no int, batch int, pos int, type string, lang string, lm_char string, glyph string, glyph_type string, char_w int, pad_w int, exposure int, v_offset int, x int, log_prob double"
    check_font(font, model)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_no")
        ems = [Emission(np.frombuffer(r.pixels, np.uint8).reshape(r.width, r.height), font, pad, offsets, model.offsets is not None) for r in frame.itertuples()]
        found, score = decode_lines(ems, model, beam, ahead)
        rows = []
        for r, em, states in zip(frame.itertuples(), ems, found, strict=True):
            for pos, (s, at, width) in enumerate(states):
                w, p, e, o = em.explain(s.glyph, at, width, s.offset) if width else (0, 0, 0, 0)
                rows.append((r.doc_id, r.line_no, r.line_no // batch, pos, s.type, s.lang, s.lm_char, s.glyph, s.glyph_type, w, p, e, o, at, score))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return lines.groupBy("doc_id", F.floor(F.col("line_no") / batch)).applyInPandas(run, schema)
