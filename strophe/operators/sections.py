"""Sections of ordered lines, held as a sorted list of borders.

A section is what lies between two borders. Cutting puts a border in, joining takes one out, so both work on one list and no
section is ever built before the borders are final. What decides about a border is the pause before it and how many spoken lines lie on
its two sides, which prefix sums give for any stretch. The lines of one item fit one task by nature.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np

from ..config import Settings

#: A line whose pause is shorter runs on into the next one; seconds a spoken line of the smaller side is worth when a long segment is cut.
PAUSE, BALANCE = 0.2, 0.15
#: A segment of fewer seconds and at most so many words is an interjection.
SHORT, FEW = 1.0, 2


class Track:
    """The lines of one item: start, end, the pause after each, and which are spoken."""

    def __init__(self, start, end, pause, spoken):
        self.start, self.end, self.pause = (np.asarray(x, float) for x in (start, end, pause))
        self.before = np.concatenate(([0], np.cumsum(np.asarray(spoken, np.int64))))

    def __len__(self) -> int:
        return len(self.start)

    def spoken(self, a, b):
        """Spoken lines in [a, b); either may be an array."""
        return self.before[b] - self.before[a]

    def lasts(self, a: int, b: int) -> float:
        return float(self.end[b - 1] - self.start[a])


def refined(borders: list[int], cut: Callable[[int, int], int | None]) -> list[int]:
    """The borders with those that ``cut`` finds between each two of them added, until it finds no more."""
    out, fresh = sorted(borders), set(pairwise(sorted(borders)))
    while fresh:
        a, b = fresh.pop()
        if (k := cut(a, b)) is not None:
            insort(out, k)
            fresh |= {(a, k), (k, b)}
    return out


def widest(t: Track, a: int, b: int, least: int, bonus: float = 0.0, pause: float = -np.inf) -> int | None:
    """The border inside [a, b) after the longest pause, with ``least`` spoken lines or more on both sides and a pause of at least
    ``pause``; each spoken line of the smaller side adds ``bonus``. The first of equals, None if there is none."""
    k = np.arange(a + 1, b)
    side = np.minimum(t.spoken(a, k), t.spoken(k, b))
    gap = t.pause[k - 1]
    worth = np.where((side >= least) & (gap >= pause), gap + bonus * side, -np.inf)
    at = int(worth.argmax()) if len(k) else 0
    return int(k[at]) if len(k) and worth[at] > -np.inf else None


def by_pauses(t: Track, s: Settings = Settings()) -> list[int]:
    """Borders 0, ..., n of sections by their pauses: at every long pause; inside sections of too many spoken lines or seconds at the
    widest pause that leaves both sides enough lines; and none around sections of too few spoken lines, as far as they can be joined.

    A small section loses the border with the shorter pause, the left one of equals, unless it has spoken lines and the joined
    section would last too long; then it stays while it is what it is. No lines have no borders.
    """
    n = len(t)
    if not n:
        return []

    def cut(a: int, b: int) -> int | None:
        if t.spoken(a, b) > s.max_lines:
            return widest(t, a, b, s.min_lines)
        return widest(t, a, b, max(1, s.min_lines // 2)) if t.lasts(a, b) > s.max_song_seconds else None

    out = refined([0, *(np.flatnonzero(t.pause[: n - 1] >= s.section_gap) + 1).tolist(), n], cut)
    settled: set[tuple[int, int]] = set()
    i = 0
    while i < len(out) - 1 and len(out) > 2:
        a, b = out[i], out[i + 1]
        if t.spoken(a, b) >= s.min_lines or (a, b) in settled:
            i += 1
            continue
        sides = [(t.pause[x - 1], x) for x in (a, b) if 0 < x < n]
        border = min(sides)[1]
        lo, hi = (out[i - 1], b) if border == a else (a, out[i + 2])
        if t.spoken(a, b) and t.lasts(lo, hi) > s.max_song_seconds:
            settled.add((a, b))
        else:
            out.remove(border)
            i = max(0, i - (border == a))
    return out


def shortened(t: Track, lines: list[int], most: int, least: int = 2) -> list[list[int]]:
    """Line numbers in pieces of at most ``most`` spoken lines, as far as there are real pauses with ``least`` spoken lines on both sides;
    never cut where singing goes on."""
    at = np.asarray(lines, np.int64)
    own = Track(t.start[at], t.end[at], t.pause[at], t.spoken(at, at + 1))
    borders = refined([0, len(own)], lambda a, b: widest(own, a, b, least, BALANCE, PAUSE) if own.spoken(a, b) > most else None)
    return [lines[a:b] for a, b in pairwise(borders)] if lines else []


def named(label: str, pieces: list[list[int]]) -> list[tuple[str, list[int]]]:
    """Pieces with their label, numbered if there are several."""
    return [(label if len(pieces) == 1 else f"{label}, {i} of {len(pieces)}", p) for i, p in enumerate(pieces, 1)]


def by_segments(t: Track, words, segments: list[tuple[str, list[int]]], s: Settings = Settings()) -> list[tuple[str, list[int]]]:
    """(label, line numbers) of sections from labelled segments: long ones are shortened, interjections left out, and a section that runs
    on into the one after it is joined with it; what gets half as long again as a section may be is shortened once more."""
    words = np.asarray(words)
    short = [x for label, lines in segments for x in named(label, shortened(t, list(lines), s.max_lines))]
    kept = [x for x in short if t.end[x[1][-1]] - t.start[x[1][0]] >= SHORT or words[x[1]].sum() > FEW]

    def joined(done: list, x: tuple[str, list[int]]) -> list:
        if not done or t.pause[done[-1][1][-1]] >= PAUSE:
            return [*done, x]
        label, lines = done[-1]
        return [*done[:-1], *named(f"{label} & {x[0]}", shortened(t, lines + x[1], int(1.5 * s.max_lines)))]

    return reduce(joined, kept, [])


def covers(segments: list[tuple[str, list[int]]], n: int) -> bool:
    """Whether segments hold the lines 0, ..., n - 1 once each and in order."""
    return [i for _, lines in segments for i in lines] == list(range(n)) and all(lines for _, lines in segments)
