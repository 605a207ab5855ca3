"""Pages to lines: NumPy kernels for one page, and the Spark operator that applies them page by page.

A page is a matrix of levels, 0 black to 255 white, x first; a line is a matrix of pixels: 0 white, 1 black, 2 obscured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_LEVEL, HEIGHT, ABOVE, BELOW = 255.0, 30, 29, 11
WHITE, BLACK, OBSCURED = 0, 1, 2


def rotate(levels: np.ndarray, angle: float) -> np.ndarray:
    """The page turned about its centre, nearest pixels, white where nothing was."""
    w, h = levels.shape
    x, y = np.meshgrid(np.arange(w) - (w - 1) / 2, np.arange(h) - (h - 1) / 2, indexing="ij")
    c, s = np.cos(angle), np.sin(angle)
    a, b = np.rint(c * x + s * y + (w - 1) / 2).astype(int), np.rint(-s * x + c * y + (h - 1) / 2).astype(int)
    inside = (a >= 0) & (a < w) & (b >= 0) & (b < h)
    out = np.full(levels.shape, MAX_LEVEL)
    out[inside] = levels[a[inside], b[inside]]
    return out


def straighten(levels: np.ndarray, steps: int = 20, most: float = 0.05) -> np.ndarray:
    """Turned by the angle whose rows' mean darkness varies most from row to row."""
    turned = [rotate(levels, a) for a in np.linspace(-most, most, steps)]
    return max(turned, key=lambda p: np.abs(np.diff((MAX_LEVEL - p).mean(axis=0))).sum())


def threshold(levels: np.ndarray, quantile: float = 0.12) -> float:
    """The first level that covers the quantile of pixels; of a page with two levels at most, the middle between them."""
    found = np.unique(levels)
    if found.size <= 2:
        return float(found.mean())
    counts = np.bincount(np.clip(levels, 0, 255).astype(int).reshape(-1), minlength=256)
    return float(np.searchsorted(np.cumsum(counts), np.ceil(counts.sum() * quantile)))


def binarize(levels: np.ndarray, quantile: float = 0.12) -> np.ndarray:
    return np.where(levels <= threshold(levels, quantile), 0.0, MAX_LEVEL)


def pixels(levels: np.ndarray) -> np.ndarray:
    return np.where(levels <= MAX_LEVEL / 2, BLACK, WHITE).astype(np.uint8)


def components(black: np.ndarray) -> np.ndarray:
    """Labels from 1 of black pixels that touch by a side; 0 elsewhere. Labels spread to the smaller until none changes."""
    label = np.where(black, np.arange(1, black.size + 1).reshape(black.shape), 0)
    while True:
        new = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                near = np.roll(label, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                near[tuple(edge)] = 0
                both = black & (near > 0)
                new[both] = np.minimum(new[both], near[both])
        jump = new.copy()
        jump[black] = new.reshape(-1)[new[black] - 1]  # follow the label to its own label
        if (jump == label).all():
            return label
        label = jump


def drop_components(levels: np.ndarray, least: int, most: int, level: float) -> np.ndarray:
    """Whiten components of pixels darker than ``level`` with fewer than ``least`` or more than ``most`` pixels."""
    label = components(levels < level)
    names, counts = np.unique(label[label > 0], return_counts=True)
    out = levels.copy()
    out[np.isin(label, names[(counts < least) | (counts > most)])] = MAX_LEVEL
    return out


def _centre(profile: np.ndarray, weights: tuple[float, float, float] = (1, 4, 1), least: float = 0.6, grow: float = 0.03) -> tuple[int, int]:
    """The middle of three segments with the least weighted variance, grown a little on both sides."""
    n = profile.size
    one, two = np.concatenate([[0], np.cumsum(profile)]), np.concatenate([[0], np.cumsum(profile**2)])
    cost = lambda a, b: (two[b] - two[a]) - (one[b] - one[a]) ** 2 / np.maximum(b - a, 1)
    step = max(1, n // 200)
    a, b = np.meshgrid(np.arange(0, n, step), np.arange(0, n + 1, step), indexing="ij")
    total = weights[0] * cost(0, a) + weights[1] * cost(a, b) + weights[2] * cost(b, n)
    total = np.where(b - a >= least * n, total, np.inf)
    i = np.unravel_index(np.argmin(total), total.shape)
    return max(0, int(a[i] - grow * n)), min(n, int(b[i] + grow * n))


def crop(levels: np.ndarray) -> np.ndarray:
    """Dark borders cut off, first left and right, then above and below, by the variation along each column or row."""
    for axis in (0, 1):
        ink = (binarize(levels) == 0).astype(float)
        a, b = _centre(np.abs(np.diff(ink, axis=1 - axis)).sum(axis=1 - axis))
        levels = levels[a:b] if axis == 0 else levels[:, a:b]
    return levels


def vertical_profile(black: np.ndarray) -> np.ndarray:
    return black.sum(axis=0).astype(float)


def baselines(profile: np.ndarray, restarts: int = 100, rounds: int = 5, low: int = 6, high: int = 30, seed: int = 0) -> list[int]:
    """Rows where the base of each line ends: a cyclic semi-Markov model of ascenders, bases and descenders.

    Sizes and blackness of the three kinds of segments are Gaussian; hard EM from random starts, all at once, the spread
    shrinking by a fifth each round; the best start by likelihood counts.
    """
    rows = profile.size
    if rows < 3 * low:
        return []
    rng = np.random.default_rng(seed)
    top = profile.max() + 1.0
    mean = rng.uniform(0, 0.5, (restarts, 3)) * top
    mean[:, 1] = rng.uniform(0.3, 1.0, restarts) * top
    size = rng.uniform(low, high, (restarts, 3))
    spread, size_spread = np.full((restarts, 3), top / 2), np.full((restarts, 3), 8.0)
    sizes = np.arange(low, high)
    best: tuple[float, list] = (-np.inf, [])
    for _ in range(rounds + 1):
        cells = -0.5 * ((profile[None, None, :] - mean[:, :, None]) / spread[:, :, None]) ** 2 - np.log(spread)[:, :, None]
        cum = np.concatenate([np.zeros((restarts, 3, 1)), np.cumsum(cells, axis=2)], axis=2)
        by_size = -0.5 * ((sizes[None, None, :] - size[:, :, None]) / size_spread[:, :, None]) ** 2 - np.log(size_spread)[:, :, None]
        score = np.full((restarts, 3, rows + 1), -np.inf)
        back = np.zeros((restarts, 3, rows + 1), int)
        score[:, :, 0] = 0.0  # any kind may come last before the page, so any may begin
        for t in range(low, rows + 1):
            s = sizes[sizes <= t]
            before = np.roll(score, 1, axis=1)[:, :, t - s]  # the kind before
            total = before + cum[:, :, [t]] - cum[:, :, t - s] + by_size[:, :, : s.size]
            pick = total.argmax(axis=2)
            score[:, :, t], back[:, :, t] = np.take_along_axis(total, pick[:, :, None], 2)[:, :, 0], s[pick]
        ends = score[:, :, rows].argmax(axis=1)
        paths = []
        for r in range(restarts):
            t, k, path = rows, int(ends[r]), []
            while t > 0 and np.isfinite(score[r, k, t]):
                n = int(back[r, k, t])
                path.append((k, t - n, t))
                t, k = t - n, (k - 1) % 3
            paths.append(path[::-1])
            if score[r, ends[r], rows] > best[0]:
                best = (float(score[r, ends[r], rows]), paths[r])
        for r, path in enumerate(paths):
            for k in range(3):
                own = [(a, b) for kind, a, b in path if kind == k]
                if own:
                    mean[r, k] = np.mean(np.concatenate([profile[a:b] for a, b in own]))
                    size[r, k] = np.mean([b - a for a, b in own])
        spread, size_spread = np.maximum(spread * 0.8, 1e-3 * top), np.maximum(size_spread * 0.8, 0.5)
    return [b for kind, _, b in best[1] if kind == 1]


def resample(line: np.ndarray, height: int = HEIGHT) -> np.ndarray:
    """A line image scaled to a height, proportions kept, nearest pixels."""
    w, h = line.shape
    width = max(1, round(w * height / h))
    x, y = ((np.arange(width) + 0.5) * w / width).astype(int), ((np.arange(height) + 0.5) * h / height).astype(int)
    return line[np.minimum(x, w - 1)][:, np.minimum(y, h - 1)]


def cut_lines(levels: np.ndarray) -> list[np.ndarray]:
    """Pixel matrices of a page's lines, top to bottom, white where a line reaches over the page."""
    black = levels <= MAX_LEVEL / 2
    out = []
    for base in baselines(vertical_profile(black)):
        line = np.full((levels.shape[0], ABOVE + BELOW), MAX_LEVEL)
        a, b = max(0, base - ABOVE), min(levels.shape[1], base + BELOW)
        line[:, a - (base - ABOVE) : a - (base - ABOVE) + b - a] = levels[:, a:b]
        out.append(pixels(resample(line)))
    return out


def extract_lines(pages: DataFrame, quantile: float = 0.12, do_crop: bool = True) -> DataFrame:
    """(doc_id, line_no, width, height, pixels) from pages (doc_id, width, height, levels): straightened, cropped, binarised, cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page in frame.itertuples():
                levels = straighten(np.frombuffer(page.levels, np.uint8).reshape(page.width, page.height).astype(float))
                levels = binarize(crop(levels) if do_crop else levels, quantile)
                rows += [(page.doc_id, k, x.shape[0], x.shape[1], x.tobytes()) for k, x in enumerate(cut_lines(levels))]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "width", "height", "pixels"])

    return pages.select("doc_id", "width", "height", "levels").mapInPandas(run, "doc_id long, line_no int, width int, height int, pixels binary")
