"""Suffix-array deduplication of byte strings, by two-stage sorting.

Every byte under a string of ``length`` bytes that also starts in a document with a smaller id is removed. Segments that
may hold such strings meet in buckets (see repeats); there the suffixes that start a string are sorted in two stages: those
smaller than their successors are sorted directly, the others follow by scanning the buckets of first bytes in order, each
suffix placing its predecessor. Common prefixes of neighbours then give the runs of equal strings.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` keep all; rows of equal ids are no
reason for each other's removal; a null id counts as larger than any other; strings are bytes, so a kept text can end
inside a character; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import Group, Kind, find_repeats

#: Symbols in a sort key: 9 bits each, byte values from 1 and 0 for ends.
KEY = 7
#: MB of text in a group; there are several times as many strings of bytes as of words.
GROUP_MB = 1


def next_place(found: np.ndarray) -> np.ndarray:
    """For each place the first from it on where ``found`` is true, or the length."""
    place = np.where(found, np.arange(len(found), dtype=np.int32), np.int32(len(found)))[::-1]
    return np.minimum.accumulate(place, out=place)[::-1]


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor."""
    up = np.append(text[1:] > text[:-1], True)  # the end counts as a step up
    return up[np.minimum(next_place(np.append(text[1:] != text[:-1], True)), len(text) - 1)] if len(text) else up[:0]


def keys(text: np.ndarray) -> np.ndarray:
    """For each place the KEY symbols from it, as a number that sorts like them."""
    out = np.zeros(len(text), np.uint64)
    for i in range(KEY):
        np.left_shift(out, np.uint64(9), out=out)
        np.bitwise_or(out[: max(len(text) - i, 0)], text[i:], out=out[: max(len(text) - i, 0)])
    return out


def sort_directly(at: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in order of the suffixes' first ``depth`` symbols: sorted by keys, ties by the keys after them."""
    order = at[np.argsort(key[at], kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    last = len(key) - 1
    for d in range(KEY, depth, KEY):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        run = np.cumsum(~same[rows])
        next_key = key[np.minimum(order[rows] + d, last)]
        by = np.lexsort((next_key, run))
        order[rows] = order[rows][by]
        next_key, run = next_key[by], run[by]
        same[rows[1:]] = (next_key[1:] == next_key[:-1]) & (run[1:] == run[:-1])
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``wanted`` suffixes (a mask) in order of their first ``depth`` symbols; with a larger suffix its successor must be wanted."""
    small = types(text)
    direct = sort_directly(np.flatnonzero(wanted & small), key, depth)
    induced = wanted & ~small
    width = int(text.max(initial=0)) + 1
    edges = np.searchsorted(text[direct], np.arange(width + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(width)]

    def scan(found: np.ndarray) -> None:
        """Each suffix found puts its predecessor, if that is larger, behind those of its bucket."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        if len(before):
            symbols = text[before]
            by = np.argsort(symbols, kind="stable")
            before, symbols = before[by], symbols[by]
            heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            for a, b in zip(heads, np.append(heads[1:], len(before)), strict=True):
                waiting[symbols[a]].append(before[a:b])

    out = []
    for c in range(width):
        done = 0
        while done < len(waiting[c]):
            fresh = np.concatenate(waiting[c][done:])
            done = len(waiting[c])
            out.append(fresh)
            scan(fresh)
        part = direct[edges[c] : edges[c + 1]]
        out.append(part)
        scan(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(order: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order, ``depth`` at most."""
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    last = len(key) - 1
    for d in range(0, depth, KEY):
        differ = key[np.minimum(order[alive] + d, last)] ^ key[np.minimum(order[alive - 1] + d, last)]
        equal = differ == 0
        shared[alive[equal]] = d + KEY
        rest = differ[~equal]
        shared[alive[~equal]] = d + KEY - 1 - sum((rest >> np.uint64(9 * k)) > 0 for k in range(1, KEY))
        alive = alive[equal]
    return np.minimum(shared, depth)


def earlier_documents(length: int):
    def earlier(text: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of each string of each segment, whether an equal one belongs to a smaller id."""
        n = len(counts)
        if not n:
            return np.zeros(0, bool)
        flat = np.zeros(len(text) + n, np.uint16)  # each segment ends with a 0
        inside = np.ones(len(flat), bool)
        inside[offsets[1:] + np.arange(n)] = False
        flat[inside] = text.astype(np.uint16) + 1
        del inside
        heads = offsets[:-1] + np.arange(n)
        shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        strings = np.repeat(heads, counts) + shift
        wanted = np.zeros(len(flat), bool)
        wanted[strings] = True
        # behind a segment's last string all up to the first small suffix, from which the larger ones follow
        small = types(flat)
        following = next_place(small)
        last = heads + counts - 1
        more = following[last] - last
        del small, following
        wanted[np.repeat(last, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1] = True
        key = keys(flat)
        order = suffix_order(flat, wanted, key, length)
        number = np.full(len(flat), -1, np.int32)
        number[strings] = np.arange(len(strings), dtype=np.int32)
        order = order[number[order] >= 0]
        new = common_prefixes(order, key, length) < length
        new[:1] = True
        ranked = number[order]
        owner = np.repeat(ids, counts)[ranked]
        least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
        out = np.zeros(len(strings), bool)
        out[ranked] = owner > least
        return out

    return earlier


def spans_of(gone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of removed symbols that don't cross texts: starts, stops, and by text the index of its first run."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[first] = True
    head = gone.copy()
    head[1:] &= ~gone[:-1] | edge[1:-1]
    tail = gone.copy()
    tail[:-1] &= ~gone[1:] | edge[1:-1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, first)


def suffix_array_dedup(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", group_mb: float = GROUP_MB) -> DataFrame:
    """``key``, n_bytes, n_removed, spans (removed, as half-open byte ranges) and kept (the other bytes) of each row."""
    kind = Kind(length, length // 2 + 1, words=False, inside=False)

    def finish(group: Group, gone: np.ndarray) -> pa.Table:
        first = group.first
        starts, stops, runs = spans_of(gone, first)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(runs))
        kept = group.text[~gone]
        left = np.zeros(len(first), np.int64)
        np.cumsum(np.add.reduceat(np.append(~gone, False), first[:-1]) * (np.diff(first) > 0), out=left[1:]) if len(first) > 1 else None
        spans = pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - first[:-1][owner]), pa.array(stops - first[:-1][owner])], names=["start", "end"]))
        return pa.table(
            {
                "id": group.rows.column("id"),
                "n_bytes": pa.array(np.diff(first)),
                "n_removed": pa.array(np.diff(first) - np.diff(left)),
                "spans": spans,
                "kept": pa.Array.from_buffers(pa.binary(), len(left) - 1, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())]),
            }
        )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = find_repeats(rows, kind, earlier_documents(length), finish, "id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary", group_mb)
    return found.withColumnRenamed("id", key)
