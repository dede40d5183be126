"""Packing token pieces into sequences by the linear grouping scheme.

What a packing needs of the documents is how many there are of each length, at most ``capacity`` numbers, so it is planned on that histogram,
whatever the number of documents. Lengths over a quarter of the capacity are sorted and cut into groups of equally many
pieces; each group's lengths are rounded up to its greatest. For these few sizes the best mix of configurations is a linear
program, solved by columns that a knapsack proposes, and rounded down to whole sequences. Actual pieces then take the places of
their group's size, longest first. What is left over and the small pieces go, longest first, to where the least room that is enough is
left, in the sequences there are or else in new ones.

The plan says which pieces of a length, by number, lie where; Spark numbers the pieces of each length by counts for each partition of a
written table, so that no task needs all pieces of one length, and looks their places up.

Defined cases: null and empty texts have no ids but the end's; texts of any length are coded whole, some 30 times their size in a
task's memory; rows of equal ids are documents of their own; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, raw, stored
from tessera.llm.sentencepieces import in_slices
from tessera.llm.words import cut_out, word_numbers

CAPACITY = 2048
#: Groups of large lengths; small is at most one part of so many of the capacity; steps of the linear program, of which each leaves a right solution.
GROUPS, SMALL, STEPS = 256, 4, 4000
#: Words, and their ids, that a worker keeps.
KEEP, KEEP_IDS = 800_000, 8_000_000
#: Bytes of text coded at a time.
SLICE = 4_000_000
#: Bytes that can't begin white space: one of these after a space starts a word for the tokenizer, whatever stands before.
STARTS = np.zeros(256, bool)
STARTS[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
#: Between one of the first and one of the second a tokenizer's word always ends.
ALNUM, MARKS = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARKS[[*b".,;:!?"]] = True
#: White space after one of these begins a word, and a line end between one of these and a start is a word of its own.
SIGNS, BLANKS = ALNUM | MARKS, np.zeros(256, bool)
BLANKS[[*b" \t\n\r"]] = True

Bin = tuple[tuple[int, int], ...]


class Words:
    """Ids of words by the library, kept from slice to slice."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            told = json.load(file)
        before = told["pre_tokenizer"] or {}
        # a byte-level tokenizer's pattern begins a word at the last space before a sign, and at a mark or white space after a letter, so texts may be cut there; others code whole texts
        self.cut = told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cut = self.cut and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """By word, each given once, its place in ``at``; words are coded that aren't known yet."""
        fresh = [w for w in words if w not in self.known]
        for a in range(0, len(fresh), 10_000):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in fresh[a : a + 10_000]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.known.update(zip(fresh[a : a + 10_000], range(len(self.at) - 1, len(self.at) - 1 + len(ids)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each starts and the last ends."""
        first = np.zeros(len(text) + 1, bool)
        if self.cut and len(text):
            first[:-2] = (text[:-1] == 32) & STARTS[text[1:]]
            first[ends[ends > 0] - 1] = False  # what follows is another text's
            first[1:-1] |= ALNUM[text[:-1]] & MARKS[text[1:]] | SIGNS[text[:-1]] & BLANKS[text[1:]]
            line = np.flatnonzero(text == 10)
            line = line[(line > 0) & (line < len(text) - 1)]
            first[line[SIGNS[text[line - 1]] & STARTS[text[line + 1]]] + 1] = True
        first[ends] = True
        starts = np.flatnonzero(first)
        starts, stops = starts[:-1], starts[1:]
        words = word_numbers(text, starts, stops)
        one = np.zeros(int(words.max(initial=-1)) + 1, np.int64)
        one[words] = np.arange(len(words))  # a place of each word
        data = text.tobytes()
        if len(self.known) + len(one) > KEEP or len(self.flat) > KEEP_IDS:
            self.clear()
        number = self.numbers([data[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)])[words]
        a, b = self.at[number], self.at[number + 1]
        out = cut_out(self.flat, a, b)
        before = np.concatenate([[0], np.cumsum(b - a)])
        return out, before[np.searchsorted(starts, ends)]


_LOADED: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The tokenizer, read once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece, start, length and ids (unsigned 32-bit numbers, little-endian) of each piece of at most ``capacity`` ids; only a document's first piece is shorter, if it has several."""
    kind = docs.schema[key].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for part in in_slices(batch, 1, SLICE):
                ids, at = words.encode(*raw(part.column(1)))
                size = np.diff(at) + 1
                whole = np.full(len(ids) + len(size), end, "<u4")
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(size)), np.diff(at))] = ids
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                length = np.where(piece == 0, (size - capacity * (count - 1))[doc], capacity)
                edges = np.concatenate([[0], np.cumsum(length)])
                start = edges[:-1] - np.repeat(np.cumsum(size) - size, count)
                blobs = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((4 * edges).tobytes()), pa.py_buffer(whole.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), blobs], names=["k", "piece", "start", "length", "ids"])
        give_back()

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(coded, f"k {kind}, piece int, start long, length long, ids binary").withColumnRenamed("k", key)


def grouped(lengths: list[int], counts: list[int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) of equally many pieces in each group, longest first."""
    total, out, made = sum(counts), [[]], 0
    for length, count in zip(lengths, counts, strict=True):
        while count:
            edge = total * len(out) // groups
            take = min(count, edge - made)
            if take > 0:
                out[-1].append((length, take))
                count, made = count - take, made + take
            if made >= edge and made < total:
                out.append([])
    return [g for g in out if g]


def knapsack(worth: np.ndarray, sizes: list[int], most: list[int], capacity: int) -> np.ndarray:
    """How many of each size, at most ``most``, fit and are worth most together."""
    best, taken = np.zeros(capacity + 1), []
    for i, size in enumerate(sizes):
        left, n = min(most[i], capacity // size) if worth[i] > 1e-12 else 0, 1
        while left > 0:
            n = min(n, left)
            w = n * size
            better = best[: capacity + 1 - w] + n * worth[i]
            take = better > best[w:] + 1e-12
            best[w:][take] = better[take]
            taken.append((i, n, w, take))
            left, n = left - n, 2 * n
    out, room = np.zeros(len(sizes), np.int64), capacity
    for i, n, w, take in reversed(taken):
        if room >= w and take[room - w]:
            out[i] += n
            room -= w
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """Numbers of sequences and how many of each size they hold: the linear program's mix that covers all ``counts``, rounded down."""
    k = len(sizes)
    need = np.array(counts, float)
    most = [min(capacity // s, c) for s, c in zip(sizes, counts, strict=True)]
    base, cost = np.diag(np.array(most, float)), np.ones(k)
    for _ in range(STEPS):
        price = np.linalg.solve(base.T, cost)
        if price.min() < -1e-9:  # more than is needed may be covered
            enter, paid = -np.eye(k)[int(price.argmin())], 0.0
        else:
            enter, paid = knapsack(price, sizes, most, capacity).astype(float), 1.0
            if price @ enter <= 1 + 1e-7:
                break
        amount, along = np.linalg.solve(base, need), np.linalg.solve(base, enter)
        up = along > 1e-9
        if not up.any():
            break
        leave = np.flatnonzero(up)[np.argmin(np.maximum(amount[up], 0) / along[up])]
        base[:, leave], cost[leave] = enter, paid
    amount = np.linalg.solve(base, need)
    return [(int(x + 1e-6), base[:, i].astype(np.int64)) for i, x in enumerate(amount) if cost[i] and int(x + 1e-6) > 0]


class Room:
    """Sequences by the room that is left in them: numbers of sequences that hold the same lengths."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list[tuple[int, Bin]]] = [[] for _ in range(capacity + 1)]
        self.rooms: list[int] = []

    def put(self, count: int, bin_: Bin, room: int) -> None:
        if count > 0:
            if not self.at[room]:
                bisect.insort(self.rooms, room)
            self.at[room].append((count, bin_))

    def take(self, room: int) -> tuple[int, Bin]:
        out = self.at[room].pop()
        if not self.at[room]:
            self.rooms.remove(room)
        return out

    def best_fit(self, length: int, count: int) -> None:
        """Pieces of one length, each to the least room that is enough; as a sequence that takes one then has the least room, it takes what it can."""
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                there, bin_ = self.take(room)
            else:
                room, there, bin_ = self.capacity, count, ()
            each = min(room // length, count)
            full = min(there, count // each)
            if bin_:
                self.put(there - full, bin_, room)
            self.put(full, (*bin_, (length, each)), room - each * length)
            count -= full * each


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, Bin]]:
    """Numbers of sequences, and the lengths that each of them holds as (length, how many)."""
    room = Room(capacity)
    lengths = sorted(histogram, reverse=True)
    large = [x for x in lengths if x * SMALL > capacity]
    rest = {x: histogram[x] for x in lengths if x * SMALL <= capacity}
    if large:
        sized = grouped(large, [histogram[x] for x in large], groups) if len(large) > groups else [[(x, histogram[x])] for x in large]
        queues = [list(reversed(g)) for g in sized]
        for count, holds in configurations([g[0][0] for g in sized], [sum(n for _, n in g) for g in sized], capacity):
            slots = [i for i, n in enumerate(holds) for _ in range(n)]
            todo = [(count, ())]
            for i in slots:  # actual pieces, longest first, take the slots of their group
                after = []
                for n, bin_ in todo:
                    while n and queues[i]:
                        length, there = queues[i].pop()
                        took = min(n, there)
                        if there > took:
                            queues[i].append((length, there - took))
                        after.append((took, (*bin_, (length, 1))))
                        n -= took
                    if n:
                        after.append((n, bin_))
                todo = after
            for n, bin_ in todo:
                if bin_:
                    room.put(n, bin_, capacity - sum(length for length, _ in bin_))
        for queue in queues:
            for length, n in queue:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        room.best_fit(length, rest[length])
    return [x for bins in room.at for x in bins]


def places(bins: list[tuple[int, Bin]]) -> dict[str, np.ndarray]:
    """Runs of pieces of one length, in order of length and number: the first piece's number and sequence, pieces in a sequence, and the first's offset."""
    runs, met, sequence = [], {}, 0
    for count, bin_ in bins:
        offset = 0
        for length, each in bin_:
            first = met.get(length, 0)
            runs.append((length, first, sequence, each, offset))
            met[length] = first + count * each
            offset += length * each
        sequence += count
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T, strict=True))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences from 0, without gaps and of at most ``capacity``. ``length`` must be from 1 to ``capacity``; columns of the new names are replaced."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # written, so that a row's partition and number hold
    rows = stored(pieces.select(F.struct(*names).alias("piece"), F.col(length).cast("long").alias("length")).withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33).alias("part")
    counts = stored(rows.groupBy(part, "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not x or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    spots = places(plan(histogram, capacity, groups))
    shared = rows.sparkSession.sparkContext.broadcast(spots)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        known = shared.value
        size, n = length.to_numpy(), number.to_numpy()
        low, high = np.searchsorted(known["length"], size, "left"), np.searchsorted(known["length"], size, "right") - 1
        while (low < high).any():  # the last run of the length that starts at n or before
            middle = (low + high + 1) // 2
            fits = known["first"][middle] <= n
            low, high = np.where(fits, middle, low), np.where(fits, high, np.minimum(high, middle - 1))
        past = n - known["first"][low]
        each = known["each"][low]
        return pd.DataFrame({"sequence_id": known["sequence"][low] + past // each, "offset": known["offset"][low] + past % each * size})

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part", "length").orderBy("number")) - 1
    numbered = rows.withColumn("part", part).withColumn("own", own).join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    found = numbered.select("piece", place("length", F.col("before") + F.col("own")).alias("at"))
    return found.select("piece.*", "at.sequence_id", "at.offset")


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id and ids of each sequence of ``placed`` (sequence_id, offset, ids as token_pieces gives them): at most the capacity's pieces for each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex(ids).alias("ids"))))
    return placed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias(ids))
