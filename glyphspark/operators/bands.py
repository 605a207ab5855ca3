"""Edit distances and alignments of many pairs at once: bit vectors of bands of diagonals.

The pairs of a batch walk their guesses together, a NumPy step a glyph. A pair's state is the band of diagonals around the straight
way, some words of bits (Myers, and Hyyrö's form that moves along the diagonals). A band is proved to hold every cheapest alignment, or
the pair is walked again in a wider one: an alignment that leaves out ``e`` glyphs on the side with fewer to leave out costs the
difference of the lengths plus ``2 * e`` at least, and also ``e`` more than the glyphs of one side that the other lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Pairs that a step is worth taking for; fewer are left to the caller, as are bands of more than ``WIDEST`` words.
LEAST, WIDEST = 24, 8
#: Pairs, and words of state over all steps, that are walked together.
PAIRS, AREA = 1024, 1 << 21
EQUAL, SUBSTITUTED, INSERTED, DELETED = range(4)
_ALL = ~np.uint64(0)


@dataclass
class Side:
    """Glyphs of many texts as numbers from 0, one text after the other."""

    codes: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.starts[k] + self.sizes[k]]

    def recoded(self, codes: np.ndarray) -> Side:
        return Side(codes, self.sizes)


def _laid(side: Side, pairs: np.ndarray, rows: int, down: np.ndarray | None = None) -> np.ndarray:
    """(rows, pairs): codes of the glyphs, texts pushed ``down``; 0 where there is none."""
    codes = side.codes
    out = np.zeros((pairs.size, rows), codes.dtype)
    starts, ends = side.starts[pairs].tolist(), (side.starts + side.sizes)[pairs].tolist()
    for own, first, end, at in zip(out, starts, ends, [0] * pairs.size if down is None else down.tolist(), strict=True):
        own[at : at + end - first] = codes[first:end]
    return np.ascontiguousarray(out.T)


def _walk(views: list[tuple[Side, Side, int]], pairs: np.ndarray, words: int, keep: bool) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Costs of ``pairs``, ordered by falling length of the guess, within bands of ``words`` words; with ``keep`` their steps.

    Glyphs are equal that are in one of the views; code 0 stands for none. Rows before a gold text fall by one each, so column 0
    takes care of itself; what lies beyond the band is taken for a substitution, so costs are never too low.
    """
    n, m = views[0][0].sizes[pairs], views[0][1].sizes[pairs]
    bits, far = 64 * words, m - n
    low = np.minimum(far, 0) - (bits - 1 - np.abs(far)) // 2
    steps, count = int(n[0]) if n.size else 0, pairs.size
    active = count - np.searchsorted(n[::-1], np.arange(steps), side="right")
    rows = max(steps + bits + 64, int((m - low).max()))
    guesses = [_laid(g, pairs, steps) for g, _, _ in views]
    golds = [_laid(h, pairs, rows, -low) for _, h, _ in views]
    tables = [np.zeros((words + 1, count * size), np.uint64) for _, _, size in views]
    places = [np.arange(count) * size for _, _, size in views]

    def fill(q: int, base: int, a: int) -> None:
        for gold, table, begin in zip(golds, tables, places, strict=True):
            own = table[q]
            for b in range(min(64, rows - base)):
                at = gold[base + b, :a] + begin[:a]
                own[at] |= np.uint64(1 << b)

    for q in range(words + 1):
        fill(q, 64 * q, count)
    place = np.arange(64 * words).reshape(words, 64, 1) >= -low
    rise = [(place[q] * (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None]).sum(0, dtype=np.uint64) for q in range(words)]
    fall = [~x for x in rise]
    on_word, on_bit = (far - low) >> 6, ((far - low) & 63).astype(np.uint64)
    same = np.zeros(count, np.uint64)
    ups, subs = [np.full(words * count, _ALL)], [np.zeros(words * count, np.uint64)]
    top = np.uint64(63)
    for s in range(steps):
        a, r = int(active[s]), s & 63
        if s and not r:
            for table in tables:
                table[:-1] = table[1:]
                table[-1] = 0
            fill(words, s + 64 * words, a)
        right, left = np.uint64(r), np.uint64(64 - r if r else 0)
        match = None
        for guess, table, begin in zip(guesses, tables, places, strict=True):
            at = guess[s, :a] + begin[:a]
            got = [table[q].take(at) for q in range(words + 1 if r else words)]
            own = [got[q] >> right | got[q + 1] << left for q in range(words)] if r else got
            match = own if match is None else [x | y for x, y in zip(match, own, strict=True)]
        diagonal, carry = [], None
        for q in range(words):
            x, up, down = match[q], rise[q][:a], fall[q][:a]
            total = (x & up) + up
            if words > 1:
                over = total < up
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            diagonal.append((total ^ up) | x | down)
        on = diagonal[0] if words == 1 else np.stack(diagonal)[on_word[:a], np.arange(a)]
        same[:a] += on >> on_bit[:a] & np.uint64(1)
        below = None
        for q in range(words):
            d, up, down = diagonal[q], rise[q][:a], fall[q][:a]
            across, back = down | ~(d | up), d & up
            moved = d >> np.uint64(1)
            if q + 1 < words:
                moved |= diagonal[q + 1] << top
            rise[q], fall[q] = back | ~(moved | across), moved & across
            if keep:
                above = rise[q] << np.uint64(1)
                if below is not None:
                    above |= below >> top
                below = rise[q]
                ups.append(d & ~match[q])
                subs.append(~(match[q] | (d & above)))
    cost = np.abs(far) + n - same.astype(np.int64)
    return cost, _traced(n, m, low, words, active, np.concatenate(ups), np.concatenate(subs)) if keep else None


def _traced(n: np.ndarray, m: np.ndarray, low: np.ndarray, words: int, active: np.ndarray, ups: np.ndarray, subs: np.ndarray) -> list[np.ndarray]:
    """Steps of alignments from the two bits of each cell, traced from the end, all pairs a step."""
    width = np.concatenate([[n.size], active])
    first = np.cumsum(width * words) - width * words
    end = np.cumsum(n + m)
    out = np.zeros(int(end[-1]), np.uint8)
    i, j, at, p = n.copy(), m.copy(), end.copy(), np.arange(n.size)
    begin = end.copy()
    while True:
        more = (i | j) > 0
        if not more.all():
            begin[p[~more]] = at[~more]
            i, j, at, p = i[more], j[more], at[more], p[more]
        if not p.size:
            break
        k = j - i - low[p]
        cell = first[i] + (k >> 6) * width[i] + p
        bit = (k & 63).astype(np.uint64)
        op = ((ups[cell] >> bit & np.uint64(1)) << np.uint64(1) | (subs[cell] >> bit & np.uint64(1))).astype(np.int64)
        at -= 1
        out[at] = op
        i -= op != INSERTED
        j -= op != DELETED
    return [out[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]


def _groups(n: np.ndarray, words: int, size: int, alone: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of pairs, ordered by falling length, that walk together; places of those much longer than the pairs after them go to ``alone``."""
    k = 0
    while k < n.size:
        after = k + LEAST - 1
        if after >= n.size or (n[k] > 256 and n[k] > 2 * n[after]):
            alone.append(k)
            k += 1
            continue
        end = k + max(LEAST, min(PAIRS, AREA // ((int(n[k]) + 64) * words), (1 << 20) // (size * (words + 1))))
        yield k, min(end, n.size)
        k = end


def walked(
    guess: Side,
    gold: Side,
    size: int,
    alone: Callable[[int], tuple[int, np.ndarray | None]],
    fold: tuple[Side, Side, int] | None = None,
    loose: tuple[np.ndarray, np.ndarray] | None = None,
    keep: bool = False,
    only: np.ndarray | None = None,
) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Costs of cheapest alignments of all pairs and, with ``keep``, their steps; ties as in ``evaluate.align``.

    Codes are below ``size``; codes of different pairs need not mean the same. ``fold`` (codes below its size, from 1 on) holds further
    glyphs that count as equal, with ``loose`` codes that are equal wherever glyphs count as equal. ``alone`` (pair) gives cost
    and steps of a pair that is not walked with others. Costs of pairs that are not in ``only`` mean nothing.
    """
    n, m = guess.sizes, gold.sizes
    far = np.abs(m - n)
    views = [(guess.recoded(guess.codes + 1), gold.recoded(gold.codes + 1), size + 1)] + ([fold] if fold else [])
    views = [(g.recoded(g.codes.astype(kind)), h.recoded(h.codes.astype(kind)), k) for g, h, k in views for kind in [np.uint8 if k <= 256 else np.int32]]
    biggest = sum(v[2] for v in views)
    costs = n + m  # right where a text is empty
    steps = [np.full(c, INSERTED if h else DELETED, np.uint8) for c, h in zip(costs.tolist(), m.tolist(), strict=True)] if keep else None
    words = (far + 31) // 64 + 1
    proved = np.zeros(n.size, bool)
    todo = np.arange(n.size) if only is None else only
    todo, left = todo[(n * m)[todo] > 0], []
    while todo.size:
        left += todo[words[todo] > WIDEST].tolist()
        again, asked = [todo[:0]], words[todo]
        for width in range(1, WIDEST + 1):
            own = todo[asked == width]
            own = own[np.argsort(-n[own], kind="stable")]
            single: list[int] = []
            for k, end in _groups(n[own], width, biggest, single):
                pairs = own[k:end]
                cost, made = _walk(views, pairs, width, keep)
                need = cost + 1
                unsure = np.flatnonzero(~proved[pairs] & (need > 64 * width))
                if unsure.size:
                    lacks = _lacking(guess, gold, pairs[unsure], size, loose)
                    need[unsure] = np.minimum(need[unsure], far[pairs[unsure]] + 1 + 2 * (cost[unsure] - lacks))
                sure = proved[pairs] | (need <= 64 * width)
                more = pairs[~sure]
                words[more] = (need[~sure] + 63) // 64
                proved[more] = True  # the band asked for holds all that cost no more
                again.append(more)
                costs[pairs[sure]] = cost[sure]
                for k2 in np.flatnonzero(sure).tolist() if keep else ():
                    steps[pairs[k2]] = made[k2]
            left += own[single].tolist()
        todo = np.concatenate(again)
    for k in left:
        costs[k], made = alone(k)
        if keep:
            steps[k] = made
    return costs, steps


def _lacking(guess: Side, gold: Side, pairs: np.ndarray, size: int, loose: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """For each pair, of the glyphs of one side those that the other lacks, of the side with more: none of them is in an equal step."""
    counts = []
    for side, codes in zip((guess, gold), loose or (guess.codes, gold.codes), strict=True):
        own = np.concatenate([codes[side.starts[k] : side.starts[k] + side.sizes[k]] + p * size for p, k in enumerate(pairs.tolist())])
        counts.append(np.bincount(own, minlength=pairs.size * size).reshape(pairs.size, size))
    more = counts[1] - counts[0]
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
