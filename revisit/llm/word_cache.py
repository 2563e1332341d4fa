"""Token ids of whole words, encoded once per distinct word and kept for later batches."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from revisit.llm.words import Words

CACHED_WORDS = 150_000


class WordCache:
    """``encode`` gives the ids of each of some words; a word's ids must not depend on its neighbours.

    The cache starts anew when it holds ``limit`` words, so memory is bounded and results are not
    affected.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = CACHED_WORDS):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.begin = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def places(self, words: Words) -> np.ndarray:
        """The cache's place of every word; valid until the next call."""
        distinct, index, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > self.limit:
            self._clear()
        hashes = distinct.tolist()
        place = np.fromiter(map(self.place.get, hashes, repeat(-1)), np.int64, len(hashes))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            texts = [words.word(i).decode("utf-8", "replace") for i in index[missing].tolist()]
            made = self.encode(texts)
            size = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.fromiter(chain.from_iterable(made), np.int32, int(size.sum()))
            at = len(self.ids) + np.cumsum(size) - size
            first = len(self.begin)
            self.begin = np.concatenate([self.begin, at])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            place[missing] = np.arange(first, first + len(missing))
            self.place.update(zip((hashes[i] for i in missing.tolist()), range(first, first + len(missing))))
        return place[inverse]

    def expand(self, place: np.ndarray) -> np.ndarray:
        """The ids of all words one after the other."""
        size = self.size[place]
        ends = np.cumsum(size)
        shift = np.repeat(self.begin[place] - (ends - size), size)
        return self.ids[np.arange(len(shift)) + shift]
