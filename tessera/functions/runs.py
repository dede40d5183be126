"""The longest run of words that a text shares with another: by looking where both are short, by one suffix array of both otherwise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Up to this product of words, their signs and signs of the text a run is looked for.
SHORT = 1 << 22


def _levels(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the strings of 1, 2, 4, .. signs that start at each place, until all differ. What is beyond the end ranks 0."""
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int32) + 1]
    n, step = len(codes), 1
    while step < n and ranks[-1].max(initial=0) < n:
        now = ranks[-1].astype(np.int64)
        behind = np.zeros(n, np.int64)
        behind[: n - step] = now[step:]
        ranks.append(np.unique(now * (n + 1) + behind, return_inverse=True)[1].astype(np.int32) + 1)
        step *= 2
    return ranks


def _shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs that the strings at places ``a`` and ``b`` have in common, from the longest equal power of two down."""
    n = len(levels[0])
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at, other = a + got, b + got
        inside = (at < n) & (other < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][at[inside]] == levels[k][other[inside]]
        got += same.astype(np.int64) << k
    return got


def by_looking(lower: list[str], text: str, least: int) -> tuple[int, int]:
    """Where the longest run of ``lower`` that ``text`` has begins, and its words: from each word on only longer ones than before are looked for, at most twice as many as there are words."""
    first, most = 0, max(least, 1) - 1
    for at in range(len(lower)):
        while at + most < len(lower) and " ".join(lower[at : at + most + 1]) in text:
            first, most = at, most + 1
    return first, most


def by_suffixes(lower: list[str], text: str) -> tuple[int, int]:
    """The same by ranking both in one suffix array by doubling; a word's longest match begins at the nearest place of ``text`` before or behind it in order.

    Work grows with the length times its square logarithm, whatever repeats; memory is some 100 bytes a sign.
    """
    joined = " ".join(lower)
    codes = np.frombuffer((joined + text).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    n = len(joined)
    codes = np.concatenate([codes[:n], [0], codes[n:]])  # a sign that neither has
    levels = _levels(codes)
    order = np.argsort(levels[-1], kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    theirs = order > n
    before = np.maximum.accumulate(np.where(theirs, np.arange(len(order)), -1))
    behind = np.minimum.accumulate(np.where(theirs, np.arange(len(order)), len(order))[::-1])[::-1]
    sizes = np.array([len(w) for w in lower])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = starts + sizes
    at = place[starts]
    match = np.zeros(len(lower), np.int64)
    for near in (before[at], behind[at]):
        ok = (near >= 0) & (near < len(order))
        match[ok] = np.maximum(match[ok], _shared(levels, starts[ok], order[near[ok]]))
    count = np.searchsorted(ends, starts + match, side="right") - np.arange(len(lower))
    first = int(count.argmax())
    return first, int(count[first])


def longest_run(said: str, text: str, least: int) -> str | None:
    """The longest run of ``least`` words or more of ``said``, one space between them, that ``text`` has, case aside; the first of equally long ones."""
    words = said.split()
    lower, text = [w.lower() for w in words], text.lower()
    if not words or not text:
        return None
    short = len(words) * len(said) * len(text) <= SHORT
    first, count = by_looking(lower, text, least) if short else by_suffixes(lower, text)
    return " ".join(words[first : first + count]) if count >= max(least, 1) else None


def longest_shared_spans(said: Column, text: Column, least: int) -> Column:
    """``longest_run`` of each item of ``said`` in ``text``: an item may begin or end within a word of the text. Null where ``said`` is null, and for items without a run; a null text has none.

    A worker holds 100 rows at a time, where Arrow would bring 10,000.
    """

    def runs(items: list[str | None] | None, body: str | None) -> list[str | None] | None:
        return None if items is None else [None if x is None or body is None else longest_run(x, body, least) for x in items]

    return F.udf(runs, ArrayType(StringType()), useArrow=False)(said, text)
