"""Words of whole texts as 64-bit hashes, by array operations on their bytes.

Words are what white space leaves, with A-Z in lower case. They count as equal if their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time.
SLICE = 1_000_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(8_2_4).integers(1, 1 << 63, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
END = _U(0x5EED0FE4D0FD0C5)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first place of each word in bytes: sums of byte values times powers of an odd number, mixed."""
    low = _LOWER[raw]
    inside = np.r_[False, ~_SPACE[low], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(raw) + 1, _STEP)) * _BACK
        down = np.cumprod(np.full(len(raw) + 1, _BACK)) * _STEP
        total = np.r_[_U(0), np.cumsum(_BYTE[low] * up[:-1])]
        return mix((total[end] - total[begin]) * down[begin]), begin


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, and long ones in pieces that end at white space, gathered to about SLICE bytes."""
    owners, parts, size = [], [], 0
    for n, text in enumerate(texts):
        raw, at = (text or "").encode(), 0
        while at < len(raw):
            stop = min(len(raw), at + SLICE)
            while stop < len(raw) and not _SPACE[raw[stop]]:  # a word is never cut
                stop += 1
            owners.append(n)
            parts.append(raw[at:stop])
            size, at = size + stop - at, stop
            if size >= SLICE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all tokens in order; each text ends with END."""
    words, of = [], []
    for owners, parts in _pieces(texts):
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])
        w, begin = hashed_words(raw)
        words.append(w)
        of.append(np.array(owners)[np.searchsorted(ends, begin, side="right")])
    words.append(np.full(len(texts), END))
    of.append(np.arange(len(texts)))
    w, d = np.concatenate(words), np.concatenate(of)
    order = np.argsort(d, kind="stable")
    return w[order], d[order]
