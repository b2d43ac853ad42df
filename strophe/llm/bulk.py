"""Words of many texts at once, as numbers.

A batch of texts is split in Arrow, each word gets a number, and what there is to know of a word is computed once for the word. What
there is to know of texts are sums and look-ups over arrays of these numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .langid import SOUNDS, Profiles, split

#: Words and tokens that are remembered.
HELD = 200_000


def distinct(k: np.ndarray) -> np.ndarray:
    """The different values in order."""
    k = np.sort(k)
    return k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k


def among(k: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of k are among different values in order."""
    if not len(values):
        return np.zeros(len(k), bool)
    at = np.searchsorted(values, k)
    at[at == len(values)] = 0
    return values[at] == k


def merged(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of keys added up."""
    k = np.concatenate([k for k, _ in kept] or [np.zeros(0, np.int64)])
    n = np.concatenate([n for _, n in kept] or [np.zeros(0, np.int64)])
    keys, at = np.unique(k, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] places, then those of the next slice."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Texts:
    """The words of some texts in order, as numbers, and for each its text."""

    def __init__(self, words: np.ndarray, size: np.ndarray):
        self.words, self.size = words, size
        self.row = np.repeat(np.arange(len(size)), size)
        self.end = np.cumsum(size)
        self.start = self.end - size

    def any(self, flags: np.ndarray) -> np.ndarray:
        """Which texts have a word that is flagged."""
        return np.bincount(self.row[flags], minlength=len(self.size)) > 0

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Sums of integers of each text's words."""
        return np.bincount(self.row, values, len(self.size)).astype(np.int64)


class Words:
    """Numbers of words; ``about`` names columns and the function of a word that gives their values.

    ``low`` and ``plain`` number the words in lower case, the latter with straight apostrophes.
    """

    def __init__(self, **about: Callable):
        self.about = {"low": lambda w: self.number(w.lower()), "plain": lambda w: self.number(w.lower().replace("’", "'"))} | about
        self.clear()

    def clear(self) -> None:
        """Forget all numbers."""
        self._tokens: dict[str, list[int]] = {}
        self._words: dict[str, int] = {}
        self._strings: dict[str, int] = {}
        self.strings: list[str] = []
        self.columns: dict[str, np.ndarray] = {}
        self.described = 0

    def full(self) -> bool:
        return len(self._tokens) > HELD or len(self._words) > HELD

    def number(self, s: str) -> int:
        """The number of a string in lower case."""
        i = self._strings.get(s)
        if i is None:
            i = self._strings[s] = len(self.strings)
            self.strings.append(s)
        return i

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def read(self, texts) -> Texts:
        """The words of an Arrow array of texts, as split() finds them in each; null is no text."""
        import pyarrow.compute as pc

        # no word holds white space, so that texts may be cut there first
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        tokens = pc.list_flatten(cut).dictionary_encode()
        known, words = self._tokens, self._words
        own = []
        for t in tokens.dictionary.to_pylist():
            ws = known.get(t)
            if ws is None:
                ws = known[t] = [words.setdefault(w, len(words)) for w in split(t)]
            own.append(ws)
        self._describe()
        size = np.array(list(map(len, own)), np.int64)
        flat = np.array([w for ws in own for w in ws], np.int64)
        at = tokens.indices.to_numpy()
        n = size[at]
        upto = np.r_[0, np.cumsum(n)]
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        return Texts(flat[slices((np.cumsum(size) - size)[at], n)], np.diff(upto[np.r_[0, ends]]))

    def _describe(self) -> None:
        if len(self._words) == self.described and self.columns:
            return
        new = list(self._words)[self.described :]
        for name, f in self.about.items():
            c = np.array([f(w) for w in new])
            self.columns[name] = np.concatenate([self.columns[name], c]) if self.described else c
        self.described = len(self._words)


def rated(p: Profiles) -> dict[str, Callable]:
    """The column ``rated``: a word's log place in each profile, whether it has a language as first word, as a later one, whether it is a sound."""
    none = [0.0] * len(p.langs)

    def f(w: str) -> list[float]:
        first, inside = p._first[w], p._inside[w]
        return [*(first or inside or none), bool(first), bool(inside), w.lower() in SOUNDS]

    return {"rated": f}


def totals(w: Words, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """What Profiles.totals says of each text."""
    r = w["rated"][t.words] if len(t.words) else np.zeros((0, w["rated"].shape[1] if w["rated"].ndim == 2 else 3))
    has = r[:, -2] > 0
    begins = t.start[t.size > 0]
    has[begins] = r[begins, -3] > 0
    sound = r[:, -1] > 0
    if sound.any():
        near = np.zeros(len(sound), bool)
        near[1:] = sound[:-1] & (t.row[1:] == t.row[:-1])
        near[:-1] |= sound[1:] & (t.row[1:] == t.row[:-1])
        has &= ~(sound & near)
    out = np.zeros((len(t.size), r.shape[1] - 3))
    if len(begins):
        out[t.size > 0] = np.add.reduceat(r[:, :-3] * has[:, None], begins)
    return out, t.sum(has)
