"""Substring deduplication over words, by prefix-partitioned suffix trees.

Every word under a window of ``length`` words that also starts earlier (in a smaller id, or before it in the same document) is
removed. Segments that may hold such windows meet in buckets (see repeats). There the suffixes that start a window are split
by variable-length prefixes: those of one first word, where too many those of two, and so on, until a group fits
``GROUP`` suffixes; short groups share a turn. Each group's subtree grows from its root downwards, a level splitting the
suffixes of every inner node by their next word and leaving those that are alone. The inner nodes that reach depth ``length``
are the repeats: of the places below one all but the earliest are removed.

Defined cases: null and empty texts have no words; texts of fewer than ``length`` words keep all; rows of equal ids and equal
places are no reason for each other's removal; a null id counts as larger than any other; other columns stay in ``row``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.repeats import GROUP_MB, Group, Kind, find_repeats
from tessera.llm.words import cut_out, word_bounds, word_numbers

#: Suffixes whose subtree is grown at once.
GROUP = 500_000
#: Words of the anchors by which windows are dealt, for windows of twice as many at least.
REACH = 6


def prefix_groups(at: np.ndarray, words: np.ndarray, length: int, most: int, depth: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes by their prefixes: (places, words that all prefixes of the group have), of ``most`` places unless they are equal throughout."""
    if len(at) <= most or depth == length:
        if len(at) > 1:
            yield at, depth
        return
    order = at[np.argsort(words[at + depth], kind="stable")]
    heads = np.flatnonzero(np.append(True, np.diff(words[order + depth]) != 0))
    ends = np.append(heads[1:], len(order))
    start = 0
    for head, end in zip(heads, ends, strict=True):
        if end - head > most:
            if head > start:
                yield order[start:head], depth
            yield from prefix_groups(order[head:end], words, length, most, depth + 1)
            start = end
        elif end - start > most:
            yield order[start:head], depth
            start = head
    if len(order) > start:
        yield order[start:], depth


def deep_nodes(at: np.ndarray, words: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of suffixes that share ``depth`` words: (places, node) of those below an inner node at depth ``length``."""
    node = np.zeros(len(at), np.int64)
    width = int(words.max(initial=0)) + 1
    for d in range(depth, length):
        if not len(at):
            break
        edge = node * width + words[at + d]
        order = np.argsort(edge, kind="stable")
        at, edge = at[order], edge[order]
        new = np.append(True, edge[1:] != edge[:-1])
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        node = np.cumsum(new[~alone]) - 1
    return at, node


def earlier_windows(length: int, most: int = GROUP):
    def earlier(text: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of each window of each segment, whether an equal one starts earlier."""
        total = int(counts.sum())
        out = np.zeros(total, bool)
        if not total:
            return out
        starts, stops, first = word_bounds(text, offsets)
        words = word_numbers(text, starts, stops)
        shift = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(first[:-1], counts) + shift
        ids, place = np.repeat(ids, counts), np.repeat(places.astype(np.int64), counts) + shift
        order = np.lexsort((place, ids))
        rank = np.zeros(total, np.int64)
        rank[order] = np.cumsum(np.append(False, (ids[order][1:] != ids[order][:-1]) | (place[order][1:] != place[order][:-1])))
        number = np.full(len(words), -1, np.int64)
        number[at] = np.arange(total)
        for group, depth in prefix_groups(at, words, length, most):
            leaves, node = deep_nodes(group, words, length, depth)
            if len(leaves):
                mine = rank[number[leaves]]
                least = np.minimum.reduceat(mine, np.flatnonzero(np.append(True, np.diff(node) != 0)))[node]
                out[number[leaves]] = mine > least
        return out

    return earlier


def substring_dedup(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text", group_mb: float = GROUP_MB) -> DataFrame:
    """The rows of ``docs`` as ``row``, with n_words, n_removed and kept (the other words, joined by spaces)."""
    kind = Kind(length, min(REACH, length // 2 + 1), words=True, inside=True)
    # the text travels once, beside the other columns
    columns = docs.columns
    others = [c for c in columns if c != text]
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in others]).alias("row"))

    def finish(group: Group, gone: np.ndarray) -> pa.Table:
        starts, stops = group.places[:-1], group.places[1:]
        left = np.zeros(len(group.first), np.int64)
        passed = np.concatenate([[0], np.cumsum(~gone)])
        size = np.concatenate([[0], np.cumsum((stops - starts)[~gone])])
        left = size[passed[group.first]]
        # each kept word brought a space behind it: a text's last one goes
        kept = cut_out(group.text, starts[~gone], stops[~gone])
        keep = np.ones(len(kept), bool)
        some = np.diff(left) > 0
        keep[left[1:][some] - 1] = False
        ends = left - np.concatenate([[0], np.cumsum(some)])
        count = np.diff(group.first)
        rest = group.rows.column("row").combine_chunks()
        rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
        column = group.rows.column("text").combine_chunks()
        whole = [(column, pa.field(text, column.type)) if c == text else (rest.field(c), rest.type.field(c)) for c in columns]
        return pa.table(
            {
                "row": pa.StructArray.from_arrays([x for x, _ in whole], fields=[x for _, x in whole]),
                "n_words": pa.array(count),
                "n_removed": pa.array(count - np.diff(passed[group.first])),
                "kept": pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept[keep].tobytes())]),
            }
        )

    row = T.StructType([T.StructField(text, f.dataType) if f.name == text else f for f in docs.schema])
    schema = T.StructType().add("row", row).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return find_repeats(rows, kind, earlier_windows(length), finish, schema, group_mb)
