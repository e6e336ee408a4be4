"""Ids of many strings, each different one encoded once while there is room to remember it."""

from __future__ import annotations

import ctypes
import sys
from bisect import bisect_right
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

_HELD: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps from task to task: one thing at a time, the last asked for."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what the worker keeps, before a task that has another use for the memory."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)  # what is free goes back to the system


class Remembered:
    """Looks strings up in a table of bounded size and encodes those it does not hold.

    ``encode`` takes a list of strings and gives their ids. Up to ``most`` strings of up to
    ``longest`` characters are remembered, the first that come (shorter ones first); others are encoded in every call
    that needs them.
    """

    def __init__(self, encode: Callable[[list[str]], list], dtype: str, most: int, longest: int = 40):
        self.encode, self.dtype, self.most, self.longest = encode, dtype, most, longest
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _fresh(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [x for low in range(0, len(strings), 20_000) for x in self.encode(strings[low : low + 20_000])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))
        return flat, np.cumsum(sizes) - sizes, sizes

    def _remember(self, strings, flat, start, size) -> None:
        first, n = len(self.place), len(strings)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = start + self.used
        self.size[first : first + n] = size
        self.place.update(zip(strings, range(first, first + n)))
        self.used += len(flat)

    def ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of strings, one after another."""
        every = list(chain.from_iterable(split))
        at = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0).tolist()
        new = sorted({every[i] for i in missing}, key=len)
        room = min(bisect_right(new, self.longest, key=len), max(0, self.most - len(self.place)))
        if room:
            self._remember(new[:room], *self._fresh(new[:room]))
        flat, start, size, extra = self.flat, self.start, self.size, {}
        if len(new) > room:
            more, begin, sizes = self._fresh(new[room:])
            extra = dict(zip(new[room:], range(len(start), len(start) + len(new) - room)))
            start, size = np.concatenate([start, begin + len(flat)]), np.concatenate([size, sizes])
            flat = np.concatenate([flat, more])
        for i in missing:
            word = every[i]
            at[i] = extra[word] if word in extra else self.place[word]
        words = np.fromiter(map(len, split), np.int64, len(split))
        return self._gather(at, words, flat, start, size)

    def _gather(self, at, words, flat, start, size) -> list[np.ndarray]:
        sizes = size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(start[at] - (ends - sizes), sizes) + np.arange(total)
        borders = np.r_[0, ends][np.cumsum(words)]
        return np.split(flat[where], borders[:-1]) if len(words) else []
