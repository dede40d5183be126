"""Strings of a fixed length that occur more than once, over groups of texts that ask each other by messages.

Texts are sequences of symbols (bytes, or words). Of the runs of ``reach`` symbols inside a string of ``length`` symbols the
one with the least hash is the string's anchor: equal strings have equal anchors. Consecutive strings mostly share theirs and
so form one segment. Texts are dealt to groups of some MB by id, anchors to buckets by hash, and four steps find all:

1. a group sends the hashes of its anchors to their buckets,
2. a bucket answers which of them occur twice or more, and which are crowded,
3. a group sends the segments of those, each different one once with its first place (of a crowded anchor, by which many
   different segments would meet in one bucket, each string on its own, dealt by its own hash),
4. a bucket keeps of equal segments the first, sorts the suffixes of those (the operator's method), part by part, and answers
   for each string of each segment whether it has an earlier place elsewhere; a group then knows it of all its strings.

Messages are blobs, one a group and bucket, and a bucket serves several groups' worth of anchors (``ANCHORS``) or of segments
(``PARTS``), so that blobs stay larger than what surrounds them. The texts are shuffled once, by group, and that exchange is
read three times; segments are a few times the size of what repeats. What a hot string adds to a bucket is a segment a group,
however many rows have it. Each step sorts what it gets, so that a task that runs again sends the same.

Hashes only bring together: a shared hash costs time, but equal segments and equal words are compared by their bytes.
A text must fit into a task's memory some 60 times over.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import give_back, group_count, raw
from tessera.llm.words import cut_out, joined, mix, same_slices, word_bounds, word_hashes

#: MB of text in a group; occurrences of an anchor over which it is crowded.
GROUP_MB, CROWDED = 2, 2000
#: Groups whose anchors, and whose segments, a bucket gets on average; the latter are sorted in as many parts. MB of text in a task.
ANCHORS, PARTS, TASK_MB = 16, 8, 64
#: The id of rows without one: after all others.
LAST = np.iinfo(np.int64).max
FACTOR = 0xD1342543DE82EF95


def run_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` hashed symbols, put together from runs of powers of two."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, out, done = symbols, 1, None, 0
    while True:
        if size & width:
            part = level[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(FACTOR, width, 1 << 64)) + part
            done += width
        if done == size:
            return mix(out)
        level = level[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)) + level[width:]
        width *= 2


def first_least(values: np.ndarray, width: int, block: int = 1 << 22) -> np.ndarray:
    """For each run of ``width`` values the place of the least one, of equal ones the first (compared by their upper 41 bits)."""
    n = len(values) - width + 1
    out = np.zeros(max(n, 0), np.int64)
    low = np.uint64((1 << 23) - 1)
    for a in range(0, n, block):
        b = min(a + block, n)
        level = (values[a : b + width - 1] & ~low) | np.arange(b + width - 1 - a, dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            level = np.minimum(level[:-size], level[size:])
            size *= 2
        if size < width:
            level = np.minimum(level[: b - a], level[width - size : width - size + b - a])
        out[a:b] = (level[: b - a] & low).astype(np.int64) + a
    return out


@dataclass
class Segments:
    """Segments of a group in order: first symbol, number of strings that start there and after, hash of the anchor."""

    at: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


@dataclass
class Group:
    """The texts of a group by (id, text), and what both steps need of them."""

    rows: pa.Table
    ids: np.ndarray
    first: np.ndarray  # by text the place of its first symbol, and the number of symbols
    text: np.ndarray  # bytes that segments are cut from
    places: np.ndarray  # by symbol its first byte there, and the length
    strings: np.ndarray  # hashes of all runs of ``length`` symbols
    segments: Segments

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


@dataclass(frozen=True)
class Kind:
    """What symbols are: ``length`` of the strings, ``reach`` of anchors, whether symbols are words, whether places within a text count."""

    length: int
    reach: int
    words: bool
    inside: bool


def load(table: pa.Table, kind: Kind) -> Group:
    give_back()  # what the group before left
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    text, ends = raw(table.column("text"))
    ids = table.column("id").fill_null(LAST).to_numpy()
    if kind.words:
        starts, stops, first = word_bounds(text, ends)
        symbols = word_hashes(text, starts, stops)
        text, places = joined(text, starts, stops)
    else:
        symbols, first, places = mix(np.arange(1, 257, dtype=np.uint64))[text], ends, np.arange(len(text) + 1)
    strings = run_hashes(symbols, kind.length)
    anchors = run_hashes(symbols, kind.reach)
    place = first_least(anchors, kind.length - kind.reach + 1)
    # strings that end in the text they start in
    whole = np.zeros(len(place) + 1, np.int64)
    sizes = np.diff(first) - kind.length + 1
    full = sizes > 0
    np.add.at(whole, first[:-1][full], 1)
    np.add.at(whole, (first[:-1] + sizes)[full], -1)
    at = np.flatnonzero(np.cumsum(whole[:-1]))
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    # least hashes are small: mixed again they spread over the buckets
    return Group(table, ids, first, text, places, strings, Segments(at[heads], np.diff(np.append(heads, len(at))), mix(anchors[place[heads]])))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def asked(group: Group, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different anchor hashes in order, how often each occurs (255 at most), where each bucket's begin."""
    hashes, counts = np.unique(group.segments.anchor, return_counts=True)
    return hashes, np.minimum(counts, 255).astype(np.uint8), np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))


def answers(table: pa.Table, counts: np.ndarray) -> np.ndarray:
    """Bits from the buckets' answers, in order of buckets; counts: bits of each bucket."""
    out = np.zeros(int(counts.sum()), bool)
    starts = np.cumsum(counts) - counts
    for bucket, bits in zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True):
        n = int(counts[bucket])
        out[starts[bucket] : starts[bucket] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


@dataclass
class Sent:
    """Different segments in the order in which they are sent, and for each segment of the group which of them it is."""

    segments: Segments
    which: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def slices(group: Group, kind: Kind, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (half open) of segments that start at ``at`` and hold ``count`` strings."""
    return group.places[at], group.places[at + count + kind.length - 1] - (1 if kind.words else 0)


def chosen(group: Group, kind: Kind, buckets: int, parts: int, replies: pa.Table) -> Sent:
    """What a group sends to the ``parts`` of all buckets together, given the ``replies`` of the ``buckets`` that anchors were sent to."""
    hashes, _, starts = asked(group, buckets)
    counts = np.diff(starts)
    crowded = answers(replies.filter(pc.equal(replies.column("step"), 1)), counts)
    again = answers(replies.filter(pc.equal(replies.column("step"), 0)), counts)
    s = group.segments
    known = np.searchsorted(hashes, s.anchor)
    take = again[known] if len(known) else np.zeros(0, bool)
    alone = crowded[known] if len(known) else np.zeros(0, bool)
    at, count, route = s.at[take], s.count[take], s.anchor[take]
    alone = alone[take]
    if alone.any():
        each = np.where(alone, count, 1)
        shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at, count, split = np.repeat(at, each) + shift, np.repeat(np.where(alone, 1, count), each), np.repeat(alone, each)
        route = np.where(split, group.strings[at], np.repeat(route, each))
    content = mix(group.strings[at] + mix(group.strings[at + count - 1] + count.astype(np.uint64)))
    part = bucket_of(route, parts)
    order = np.lexsort((content, part))
    new = np.ones(len(order), bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (part[order][1:] != part[order][:-1])
    head, stop = slices(group, kind, at[order], count[order])
    same = np.flatnonzero(~new)
    new[same] = ~same_slices(group.text, head[same - 1], stop[same - 1], head[same], stop[same])
    which = np.zeros(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]  # the sort is stable: of equal segments the first in order of (id, place)
    return Sent(Segments(at, count, route), which, first, part[first])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of ``counts`` numbers each."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def firsts(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each slice the one of equal bytes with the least (id, place)."""
    hashes = word_hashes(text, starts, stops)
    order = np.lexsort((places, ids, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    same = np.flatnonzero(~new)
    a, b = order[same - 1], order[same]
    new[same] = ~same_slices(text, starts[a], stops[a], starts[b], stops[b])
    out = np.zeros(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def marked(group: Group, kind: Kind, sent: Sent, later: np.ndarray) -> np.ndarray:
    """By symbol whether a string over it has an earlier place; later: that of each string of the segments sent."""
    s = sent.segments
    origin = sent.first[sent.which]
    docs = group.ids[group.doc(s.at)]
    same = docs == docs[origin]
    if kind.inside:
        here = s.at - group.first[group.doc(s.at)]
        same &= here == here[origin]
    count = s.count[sent.first]
    starts = np.cumsum(count) - count
    each = s.count
    shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    gone = later[np.repeat(starts[sent.which], each) + shift] | ~np.repeat(same, each)
    at = (np.repeat(s.at, each) + shift)[gone]
    cover = np.zeros(int(group.first[-1]) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + kind.length, -1)
    return np.cumsum(cover[:-1]) > 0


def find_repeats(
    docs: DataFrame,
    kind: Kind,
    earlier: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    finish: Callable[[Group, np.ndarray], pa.Table],
    schema: str | T.StructType,
    group_mb: float = GROUP_MB,
) -> DataFrame:
    """Apply ``finish`` to each group of ``docs`` (id long, text, any others) with the symbols whose string has an earlier place.

    ``earlier`` gets a bucket's segments: bytes, offsets, numbers of strings, ids, places; it says of each string, in order,
    whether an equal one has a smaller id (or place, where places within a text count).
    """
    n = group_count(docs, F.col("text"), group_mb)
    buckets, ends = -(-n // ANCHORS), -(-n // PARTS)
    dealt = docs.withColumn("group", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    tasks = math.ceil(n * group_mb / TASK_MB)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # so that a task reads as much at every size
        dealt = dealt.repartition(tasks, "group")

    def ask(table: pa.Table) -> pa.Table:
        group = load(table, kind)
        hashes, counts, starts = asked(group, buckets)
        packed = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :5]
        full = np.flatnonzero(np.diff(starts))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "group": pa.array(np.full(len(full), table.column("group")[0].as_py()), pa.int32()),
                "hashes": pa.array([packed[starts[i] : starts[i + 1]].tobytes() for i in full], pa.binary()),
                "counts": pa.array([counts[starts[i] : starts[i + 1]].tobytes() for i in full], pa.binary()),
            }
        )

    def compare(table: pa.Table) -> pa.Table:
        packed, ends = raw(table.column("hashes"))
        counts, _ = raw(table.column("counts"))
        wide = np.zeros((len(packed) // 5, 8), np.uint8)
        wide[:, :5] = packed.reshape(-1, 5)
        _, which = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(which, counts)[which]
        rows = [(g, total[a // 5 : b // 5]) for g, a, b in zip(table.column("group").to_pylist(), ends[:-1], ends[1:], strict=True)]
        out = [(g, 0, np.packbits(t > 1).tobytes()) for g, t in rows] + [(g, 1, np.packbits(t > CROWDED).tobytes()) for g, t in rows if (t > CROWDED).any()]
        bucket = table.column("bucket")[0].as_py()
        return pa.table(
            {
                "group": pa.array([x[0] for x in out], pa.int32()),
                "step": pa.array([x[1] for x in out], pa.int32()),
                "bucket": pa.array([bucket] * len(out), pa.int32()),
                "bits": pa.array([x[2] for x in out], pa.binary()),
            }
        )

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        group = load(table, kind) if table.num_rows else None
        if group is None or not replies.num_rows:
            return SENT.empty_table()
        sent = chosen(group, kind, buckets, ends * PARTS, replies)
        at, count = sent.segments.at[sent.first], sent.segments.count[sent.first]
        starts, stops = slices(group, kind, at, count)
        ids = group.ids[group.doc(at)]
        inside = (at - group.first[group.doc(at)]).astype(np.int32)
        shares = np.bincount(sent.parts, minlength=ends * PARTS).astype(np.uint32).reshape(ends, PARTS)
        edges = np.concatenate([[0], np.cumsum(shares.sum(1).astype(np.int64))])
        full = np.flatnonzero(np.diff(edges))
        blobs = {k: [] for k in BLOBS}
        for i in full:
            part = slice(edges[i], edges[i + 1])
            blobs["text"].append(cut_out(group.text, starts[part], stops[part]).tobytes())
            blobs["shares"].append(shares[i].tobytes())
            blobs["sizes"].append((stops - starts)[part].astype(np.uint32).tobytes())
            blobs["counts"].append(count[part].astype(np.uint16).tobytes())
            blobs["ids"].append(ids[part].tobytes())
            blobs["places"].append(inside[part].tobytes() if kind.inside else b"")
        number = table.column("group")[0].as_py()
        return pa.table({"bucket": pa.array(full, pa.int32()), "group": pa.array([number] * len(full), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in blobs.items()})

    def answer(table: pa.Table) -> pa.Table:
        give_back()
        table = table.sort_by("group")
        text, _ = raw(table.column("text"))
        sizes = raw(table.column("sizes"))[0].view(np.uint32).astype(np.int64)
        counts, at = raw(table.column("counts"))
        counts, at = counts.view(np.uint16).astype(np.int64), at // 2
        ids = raw(table.column("ids"))[0].view(np.int64)
        places = raw(table.column("places"))[0].view(np.int32) if kind.inside else np.zeros(len(ids), np.int32)
        shares = raw(table.column("shares"))[0].view(np.uint32)
        part = np.repeat(np.tile(np.arange(PARTS), len(shares) // PARTS), shares)
        stops, strings = np.cumsum(sizes), np.cumsum(counts)
        later = np.zeros(int(counts.sum()), bool)
        for p in range(PARTS):
            mine = np.flatnonzero(part == p)
            one = firsts(text, stops[mine] - sizes[mine], stops[mine], ids[mine], places[mine])
            some, which = np.unique(one, return_inverse=True)
            some = mine[some]
            offsets = np.concatenate([[0], np.cumsum(sizes[some])])
            said = earlier(cut_out(text, stops[some] - sizes[some], stops[some]), offsets, counts[some], ids[some], places[some])
            # a segment equal to an earlier one has all its strings there
            behind = (ids[mine] != ids[mine[one]]) | (places[mine] != places[mine[one]])
            heads = np.cumsum(counts[some]) - counts[some]
            to = spread(strings[mine] - counts[mine], counts[mine])
            later[to] = said[spread(heads[which], counts[mine])] | np.repeat(behind, counts[mine])
        edges = np.concatenate([[0], strings])[at]
        bits = [np.packbits(later[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"group": table.column("group").cast(pa.int32()), "step": pa.array([2] * len(bits), pa.int32()), "bucket": table.column("bucket").cast(pa.int32()), "bits": pa.array(bits, pa.binary())})

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(load(table, kind), np.zeros(0, bool))
        group = load(table, kind)
        if not replies.num_rows:
            return finish(group, np.zeros(int(group.first[-1]), bool))
        sent = chosen(group, kind, buckets, ends * PARTS, replies)
        count = sent.segments.count[sent.first]
        bits = np.bincount(sent.parts // PARTS, count, minlength=ends).astype(np.int64)
        later = answers(replies.filter(pc.equal(replies.column("step"), 2)), bits)
        return finish(group, marked(group, kind, sent, later))

    by_group = dealt.groupBy("group")
    anchors = by_group.applyInArrow(ask, "bucket int, group int, hashes binary, counts binary")
    replies = anchors.groupBy("bucket").applyInArrow(compare, REPLY)
    segments = by_group.cogroup(replies.groupBy("group")).applyInArrow(send, "bucket int, group int, " + ", ".join(f"{k} binary" for k in BLOBS))
    said = segments.groupBy("bucket").applyInArrow(answer, REPLY)
    return by_group.cogroup(replies.unionByName(said).groupBy("group")).applyInArrow(apply, schema)


BLOBS = ("text", "shares", "sizes", "counts", "ids", "places")
REPLY = "group int, step int, bucket int, bits binary"
SENT = pa.schema([("bucket", pa.int32()), ("group", pa.int32())] + [(k, pa.binary()) for k in BLOBS])
