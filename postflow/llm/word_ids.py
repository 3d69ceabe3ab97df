"""Token ids of many texts by way of their distinct words: each distinct word is encoded once in a worker, then looked up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from .kernels import ranges

LIMIT = 1 << 21  # words kept in a worker, in about 40 bytes each


class WordIds:
    """encode: from a list of texts to their lists of ids. It must give a text's ids as those of its words, one after the other."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and the slot of each
        self.flat, self.start, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _add(self, texts: list[str]) -> None:
        """Gives the texts the next slots."""
        found = self.encode(texts)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        n, k = len(self.keys), int(lens.sum())
        while n + len(texts) > len(self.start):
            self.start, self.count = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.count, np.zeros_like(self.count)]
        while self.used + k > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.start[n : n + len(texts)] = self.used + np.cumsum(lens) - lens
        self.count[n : n + len(texts)] = lens
        self.flat[self.used : self.used + k] = np.fromiter((i for x in found for i in x), np.uint32, k)
        self.used += k

    def __call__(self, hashes: np.ndarray, text_of: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each word has. text_of gives the text of the word at a place."""
        codes, distinct = pd.factorize(hashes)
        if len(self.keys) + len(distinct) > LIMIT:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        slots = np.empty(len(distinct), np.int64)
        slots[known] = self.slot[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            slots[new] = len(self.keys) + np.arange(len(new))
            self._add([text_of(i) for i in first[new].tolist()])
            order = new[np.argsort(distinct[new])]
            self.keys, self.slot = np.insert(self.keys, at[order], distinct[order]), np.insert(self.slot, at[order], slots[order])
        slots = slots[codes]
        count = self.count[slots].astype(np.int64)
        return self.flat[ranges(self.start[slots], count)], count
