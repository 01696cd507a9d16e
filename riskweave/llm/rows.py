"""Rows of numbers per distinct word, kept in a bounded table of each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Words kept before the table starts anew, and words of text taken at a time.
WORDS = 200_000
PORTION = 1 << 17


class _Numbers(dict):
    """word -> its number; a new word gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


class RowTable:
    """`rows(words)`: numbers of the words' rows in `values`, which `make(new words)` fills; `make` of no
    words gives no rows of the right width."""

    def __init__(self, make: Callable[[list], np.ndarray], size: int = WORDS):
        self.make, self.size = make, size
        self.numbers = _Numbers()
        self.held, self.used = make([]), 0

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.used]

    def rows(self, words: list) -> np.ndarray:
        if len(self.numbers) > self.size:
            self.numbers, self.used = _Numbers(), 0
        numbers = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        if self.numbers.new:
            made = self.make(self.numbers.new)
            need = self.used + len(made)
            if need > len(self.held):
                grown = np.zeros((max(need, 2 * len(self.held)), *made.shape[1:]), dtype=made.dtype)
                if self.used:
                    grown[: self.used] = self.values
                self.held = grown
            self.held[self.used : need] = made
            self.used = need
            self.numbers.new = []
        return numbers


def portions(texts: Iterable, split: Callable[[str], list]) -> Iterator[tuple[list, np.ndarray]]:
    """(words, number of words of each text) for bounded portions of Arrow texts; null is empty."""
    words: list = []
    counts: list[int] = []
    held = 0
    for text in texts:
        text = text.as_py() or ""
        own = split(text)
        words += own
        counts.append(len(own))
        held += len(own)
        if held >= PORTION:
            yield words, np.array(counts)
            words, counts, held = [], [], 0
    if counts:
        yield words, np.array(counts)


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of no rows gives zeros."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out
