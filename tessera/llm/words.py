"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= ODD
    x ^= x >> np.uint64(32)
    return x


def word_bounds(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``text``, which holds texts from ends[i] to ends[i + 1]; and by text the index of its first word, with the number of words last."""
    inside = ~SPACE[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def joined(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each starts; the last entry is the length."""
    sizes = ends - starts
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=places[1:])
    out = np.full(places[-1], 32, np.uint8)
    if len(starts):
        shift = np.repeat(places[:-1] - starts, sizes)
        inside = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out[inside + shift] = text[inside]
    return out, places


def cut_out(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The slices one after another."""
    sizes = stops - starts
    return flat[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def same_slices(flat: np.ndarray, one: np.ndarray, one_end: np.ndarray, two: np.ndarray, two_end: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Whether the slices one:one_end and two:two_end hold equal bytes, pair by pair."""
    sizes = one_end - one
    out = sizes == two_end - two
    for a in range(0, len(out), block):
        i = a + np.flatnonzero(out[a : a + block] & (sizes[a : a + block] > 0))
        if len(i):
            differ = cut_out(flat, one[i], one_end[i]) != cut_out(flat, two[i], two_end[i])
            out[i] = np.add.reduceat(differ, np.cumsum(sizes[i]) - sizes[i]) == 0
    return out


def word_numbers(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes only."""
    hashes = word_hashes(text, starts, ends)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    same = np.flatnonzero(~new)
    a, b = order[same - 1], order[same]
    new[same] = ~same_slices(text, starts[a], ends[a], starts[b], ends[b])
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    if len(same) and (new[same]).any():  # equal hashes of different bytes, perhaps in turns
        data, known = text.tobytes(), {}
        out[:] = [known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out


_POWERS = {0: np.ones(1, np.uint64)}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1024), base, np.uint64)
        kept[0] = 1
        _POWERS[base] = kept = np.multiply.accumulate(kept)
    return kept[:n]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever stands around it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    at = np.arange(total) - np.repeat(offsets, sizes)
    letters = text[np.repeat(starts, sizes) + at]
    table = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    sums = np.add.reduceat(table[letters] * _powers(int(sizes.max()), 0xD1342543DE82EF95)[at], offsets)
    return mix(sums + mix(sizes.astype(np.uint64)))


def word_checks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes of another kind than ``word_hashes``: the sum of a number for each byte and its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    letters = text[np.repeat(starts, sizes) + at]
    return mix(np.add.reduceat(mix((at.astype(np.uint64) * np.uint64(256) + letters + np.uint64(1)) * ODD), offsets) + sizes.astype(np.uint64))
