"""External induced sorting of suffixes.

Suffixes that start lower than their left neighbour's (the LMS suffixes) are put in order by
sorting the substrings between them, naming these and sorting the string of names by recursion;
all others are induced from them in two scans, by a priority queue per scan that holds suffix
tuples under their first symbol. As a scan meets suffixes in order, what it pushes under a symbol
is in order too, so the queue is a list of runs per symbol, popped by symbol. Runs beyond a
memory budget are written to one temporary file of the task and read again when popped.

The recursion ends where all names differ, or where there are more than ``MANY``: a scan takes a
round per symbol, and doubling the ranks of the then much shorter string takes less time.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Names beyond which ranks are doubled.
MANY = 4_096


class SymbolQueue:
    """Runs of suffix numbers per symbol, in the order pushed; on disk beyond ``limit`` numbers."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, 0, None
        self.runs: dict[int, list] = defaultdict(list)

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        cut = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]
        for begin, end in zip(cut[:-1], cut[1:], strict=True):
            self.runs[int(symbols[begin])].append(suffixes[begin:end])
        self.held += len(suffixes)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            if in_memory := [r for r in runs if not isinstance(r, tuple)]:
                whole = np.concatenate(in_memory)
                at = self.file.tell()
                self.file.write(whole.tobytes())
                runs[:] = [*(r for r in runs if isinstance(r, tuple)), (at, len(whole), whole.dtype)]
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        runs = self.runs.pop(symbol, None)
        if runs is None:
            return None
        read = []
        for r in runs:
            if isinstance(r, tuple):
                self.file.seek(r[0])
                r = np.frombuffer(self.file.read(r[1] * r[2].itemsize), r[2])
            else:
                self.held -= len(r)
            read.append(r)
        return np.concatenate(read) if len(read) > 1 else read[0]


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix, the least symbol alone, is too."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    return np.r_[text[run_end] < text[run_end + 1], True]


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes, from LMS suffixes in the order wanted within a symbol."""
    symbols = np.unique(text)
    starts = text[lms]
    order = np.argsort(starts, kind="stable")
    by_symbol = dict(zip(np.unique(starts).tolist(), np.split(lms[order], np.flatnonzero(np.diff(starts[order])) + 1), strict=True))
    larger: dict[int, np.ndarray] = {}
    queue = SymbolQueue(limit)

    def before(batch: np.ndarray, want_small: bool) -> np.ndarray:
        prior = batch[batch > 0] - 1
        return prior[small[prior] == want_small]

    for c in symbols.tolist():  # larger suffixes, ascending
        got, batch = [], queue.pop(c)
        while batch is not None and len(batch):
            got.append(batch)
            prior = before(batch, False)
            first = text[prior]
            batch = prior[first == c]
            other = first != c
            queue.push(first[other], prior[other])
        if got:
            larger[c] = np.concatenate(got)
        if c in by_symbol:
            prior = before(by_symbol[c], False)
            queue.push(text[prior], prior)
    queue = SymbolQueue(limit)
    out = []
    for c in symbols[::-1].tolist():  # smaller suffixes, descending
        got, batch = [], queue.pop(c)
        if c == int(symbols[0]):
            batch = np.array([len(text) - 1], lms.dtype)
        while batch is not None and len(batch):
            got.append(batch)
            prior = before(batch, True)
            first = text[prior]
            batch = prior[first == c]
            other = first != c
            queue.push(first[other], prior[other])
        out += got
        if c in larger:
            down = larger[c][::-1]
            out.append(down)
            prior = before(down, True)
            queue.push(text[prior], prior)
    return np.concatenate(out)[::-1]


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling of ranks."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        after = np.r_[rank[width:] + 1, np.zeros(min(width, n), np.int64)][:n]
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(pair[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def suffix_order(text: np.ndarray, limit: int = 4_000_000) -> np.ndarray:
    """Suffix numbers of text in order. text: numbers, the last of which is less than all others."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    small = _smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    rough = _induce(text, small, lms, limit)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # Substrings from one LMS place to the next are compared by their length and a hash of their symbols.
    step = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(step), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.full(n + 1, s)) * t for s, t in ((step, back), (back, step)))
        value = text.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.r_[np.uint64(0), np.cumsum(value * up[:-1])]
        end = np.minimum(np.r_[lms[1:], n - 1] + 1, n)
        hashed = (total[end] - total[lms]) * down[lms]
        del up, down, value, total
    number = np.full(n, -1, np.int32)
    number[lms] = np.arange(len(lms))
    at = number[ordered]
    same = (hashed[at[1:]] == hashed[at[:-1]]) & ((end - lms)[at[1:]] == (end - lms)[at[:-1]])
    names = np.empty(len(lms), np.int32)
    names[at] = np.r_[0, np.cumsum(~same)]
    count = int(names.max()) + 1
    if count < len(lms):
        ordered = lms[_doubled(names) if count > MANY else suffix_order(names, limit)]
    return _induce(text, small, ordered, limit)
