"""SimHash near-duplicates: fingerprints by majority of shingle hashes, links by multi-index hashing.

A fingerprint's 64 bits are cut into segments. Fingerprints that differ in ``DISTANCE`` bits at most differ in at most
DISTANCE // segments bits of some segment; so each is filed by each of its segments' values and looked up under all values
of the small Hamming ball around them, and the full distance of those that meet is verified. Of two that differ in a
segment only the one with the smaller value looks the other up. The plan is the same at every size: three segments of 21 or
22 bits and balls of radius 1, which file a fingerprint 35 times on average; with n fingerprints a lookup meets n / 2**21.

Equal fingerprints are one node. Buckets in which over ``BLOCK`` are filed are cut into blocks that are buckets of their
own, and lookups pass in chunks, so a task holds one block of a bucket at a time.

``similar_groups`` is for a similarity well below that of 4 bits: it finds candidates by wider fingerprints and then compares
the sets of shingles themselves; see there.

Defined cases: null and empty texts have fingerprint zero; fewer words than a shingle are one shingle; each row of a repeated
id has its own fingerprint and that one's component; a null id never is a component's smallest unless all are null; other
columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.buckets import connect, dealt
from tessera.llm.common import give_back, raw, stored
from tessera.llm.components import components
from tessera.llm.repeats import run_hashes
from tessera.llm.words import LOWER, ODD, joined, mix, word_bounds, word_hashes

SEED = 42
BLOCK = 20_000
#: Segments of a fingerprint.
SEGMENTS = 3
#: Bytes of text hashed at once.
SLICE = 8 << 20
#: Of similar_groups: 64-bit numbers in a fingerprint; differing bits beyond which a pair isn't tried (at similarity 0.8, 29 differ on
#: average, with a deviation of 5); rows of a bucket that are compared in step with other buckets; near pairs a row that make a bucket
#: dense; rows looked at together; bytes of text taken apart at once; rows of a bucket by which central ones are told;
#: partners that a row of another group tries first; bits of an odd sketch.
WIDE, FAR, SMALL, DENSE, CHUNK, PIECE, LOOKED_AT, NEAREST, ODD_BITS = 3, 48, 64, 2, 100_000, 2 << 20, 64, 4, 1024


def majorities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of each run first[i]:first[i + 1]; empty runs give zero."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # counters of 16 bits, four to a number, over pieces that can't overflow
    pieces = -(-sizes[full] // 65535)
    owner = np.repeat(np.arange(len(full)), pieces)
    starts = first[:-1][full][owner] + 65535 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    heads = np.cumsum(pieces) - pieces
    lanes, low = np.uint64(0x0001000100010001), np.uint64(0xFFFF)
    half = sizes[full].astype(np.uint64)
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        for lane in range(4):
            counts = np.add.reduceat((sums >> np.uint64(16 * lane)) & low, heads)
            out[full] |= (2 * counts > half).astype(np.uint64) << np.uint64(16 * lane + bit)
    return out


def shingle_hashes(text: np.ndarray, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts that lie in ``text`` from ends[i] to ends[i + 1], and where each text's begin."""
    text = LOWER[text]
    starts, stops, first = word_bounds(text, ends)
    flat, places = joined(text, starts, stops)
    count = np.diff(first)
    runs = np.zeros(len(first), np.int64)
    runs[1:] = np.cumsum(np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1)))
    at = np.repeat(first[:-1] - runs[:-1], np.diff(runs)) + np.arange(runs[-1])
    upto = at + np.repeat(np.minimum(count, shingle), np.diff(runs))
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(places[at].tolist(), (places[upto] - 1).tolist(), strict=True)), np.uint64, len(at)), runs


def with_fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, the key, and fp, the fingerprint as a signed long, of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw(batch.column(1))
            out = np.zeros(batch.num_rows, np.uint64)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
                out[a:b] = majorities(*shingle_hashes(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle))
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["k", "fp"])
        give_back()

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(work, f"k {docs.schema[key].dataType.simpleString()}, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``count`` segments of 64 bits."""
    cuts = [-(-64 * i // count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def balls(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with 1 to ``radius`` of them set."""
    rings = [[0]]
    for _ in range(radius):
        rings.append([m | 1 << b for m in rings[-1] for b in range(m.bit_length(), bits)])
    return [m for ring in rings[1:] for m in ring]


def filed(nodes: DataFrame, node: str, values: list[tuple[Column, int]], radius: int) -> DataFrame:
    """``nodes`` under (segment, key): their own values of each segment (value, bits) are home, the greater ones in the ball around them are not."""

    def under(segment: int, own: Column, bits: int) -> list[Column]:
        masks = F.array(*[F.lit(m).cast("long") for m in balls(bits, radius)])
        around = F.filter(F.transform(masks, lambda m: own.bitwiseXOR(m)), lambda v: v > own)

        def entry(value: Column, home: bool) -> Column:
            return F.struct(F.lit(segment).alias("segment"), value.alias("key"), F.lit(home).alias("home"))

        return [F.array(entry(own, True)), F.transform(around, lambda v: entry(v, False))]

    rows = [x for i, (own, bits) in enumerate(values) for x in under(i, own, bits)]
    return nodes.select(F.col(node).alias("id"), F.col("fp").alias("data"), F.explode(F.concat(*rows)).alias("e")).select("id", "data", "e.*")


def meet(entries: DataFrame, distance: int, decode: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """a and b: nodes that meet in a bucket of ``entries`` (id, data, segment, key, home) at ``distance`` bits or fewer, as many as connect what such pairs connect."""
    # buckets of many homes: each block of them is a bucket, in which other blocks' homes look up too
    crowded = entries.where("home").groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    return connect(dealt(entries, crowded, ["segment", "key"], BLOCK), lambda x, y: np.bitwise_count(x ^ y).sum(-1) <= distance, decode)


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """a and b: pairs of ``nodes``' distinct fp at ``distance`` bits or fewer, as many as connect what such pairs connect."""
    cuts = segments(SEGMENTS)
    values = [(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)), bits) for shift, bits in cuts]
    return meet(filed(nodes, "fp", values, distance // len(cuts)), distance, lambda column: column.to_numpy().view(np.uint64)[:, None])


def with_components(marked: DataFrame, distance: int = 4) -> DataFrame:
    """``marked`` (k, fp) with component: the smallest k that links of fingerprints reach."""
    marked = stored(marked)
    nodes = marked.groupBy("fp").agg(F.min("k").alias("first"))
    reached = components(links(nodes.select("fp"), distance))
    roots = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    named = roots.join(firsts, "component").select("fp", "component_id")
    return marked.join(stored(named), "fp")


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, fingerprint (hexadecimal) and component_id of each row."""
    found = with_components(with_fingerprints(docs, shingle, key, text), distance)
    return found.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_shingles(text: np.ndarray, ends: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The set of shingles of each text that lies in ``text`` from ends[i] to ends[i + 1], as sorted hashes; a text of fewer words is one shingle."""
    text = LOWER[text]
    starts, stops, first = word_bounds(text, ends)
    symbols = word_hashes(text, starts, stops)
    whole = run_hashes(symbols, shingle)
    count = np.diff(first)
    out = [np.unique(whole[a : a + n - shingle + 1]) if n >= shingle else np.zeros(0, np.uint64) for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True)]
    for size in range(1, shingle):
        short = np.flatnonzero(count == size)
        if len(short):
            hashes = run_hashes(symbols, size)[first[short]] + np.uint64(size)
            for i, h in zip(short.tolist(), hashes, strict=True):
                out[i] = np.array([h])
    return out


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE 64-bit numbers for each set: majorities of its hashes' bits, and of those of their mixtures."""
    runs = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return np.stack([majorities(mix(hashes + x), runs) for x in np.arange(WIDE, dtype=np.uint64) * ODD], axis=1)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of hashes fall on i; sketches differ in no more bits than their sets in elements."""
    return np.packbits(np.bincount((mix(hashes) % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS).astype(np.uint8) & 1).tobytes()


def sketched(sets: DataFrame) -> DataFrame:
    """node and sketch of ``sets`` (node, set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [odd_sketch(np.frombuffer(x, np.uint64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "sketch"])

    return sets.select("node", "set").mapInArrow(work, "node long, sketch binary")


def _sets(rows: DataFrame, shingle: int, made: Callable[[list[np.ndarray]], list[bytes]], name: str) -> DataFrame:
    """``rows`` (text t last) with n, the number of different shingles, and ``name``, what ``made`` makes of their hashes, for t."""
    kept = rows.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw(batch.column(len(kept)))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE, "right")) - 1)
                each = text_shingles(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array([len(x) for x in each], pa.int32()), pa.array(made(each), pa.binary())], names=[*kept, "n", name])
                a = b
        give_back()

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(work, ", ".join([*kinds, "n int", f"{name} binary"]))


def filed_wide(nodes: DataFrame, radius: int = 1) -> DataFrame:
    """``nodes`` (node, n, fp) under their segments' values, where they are home, and under the greater values in the balls around them."""
    masks = np.array([0, *balls(16, radius)], np.uint16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                own = raw(part.column(2))[0].view(np.uint16).reshape(part.num_rows, -1)
                values = own[:, :, None] ^ masks
                row, segment, way = np.nonzero((values > own[:, :, None]) | (masks == 0))
                bucket = segment.astype(np.int64) << 16 | values[row, segment, way]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(way == 0), *(part.column(i).take(at) for i in range(3))], names=["bucket", "home", "node", "n", "fp"])

    return nodes.select("node", "n", "fp").mapInArrow(work, "bucket long, home boolean, node long, n int, fp binary")


@dataclass
class Rows:
    """Rows of buckets: sorted by bucket, homes first, then by node; ``fp`` holds WIDE numbers, and after them those of an odd sketch, if there is one."""

    bucket: np.ndarray
    home: np.ndarray
    node: np.ndarray
    n: np.ndarray
    fp: np.ndarray
    group: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(*(getattr(self, f.name)[at] for f in fields(self)))

    def near(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Whether rows may have Jaccard 4/5: by the sizes of their sets, few enough differing bits, and a difference of at most a ninth of both sizes."""
        n, m = self.n[i], self.n[j]
        may = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.bitwise_count(self.fp[i, :WIDE] ^ self.fp[j, :WIDE]).sum(-1) <= FAR)
        if self.fp.shape[1] > WIDE:
            at = np.flatnonzero(may)
            i, j = np.broadcast_to(i, may.shape)[at], j[at]
            may[at] = 9 * np.bitwise_count(self.fp[i, WIDE:] ^ self.fp[j, WIDE:]).sum(-1, dtype=np.int64) <= self.n[i].astype(np.int64) + self.n[j]
        return may


def central(rows: Rows, head: int, size: int, homes: int) -> np.ndarray:
    """A bucket's homes in order of their mean distance from some of its rows: what copies were made of lies nearer to them than they to each other."""
    some = rows.fp[head + np.unique(np.linspace(0, size - 1, LOOKED_AT).astype(int))]
    far = [np.bitwise_count(rows.fp[head + a : head + min(a + 1000, homes), None] ^ some).sum(-1, dtype=np.int64).sum(1) for a in range(0, homes, 1000)]
    return np.argsort(np.concatenate(far), kind="stable")


def leaders(rows: Rows, head: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a bucket's homes each that no more central one is near to, with all homes near to it and the first other row; the others meet homes of their own elsewhere."""
    homes = int(rows.home[head : head + size].sum())
    left, others = np.ones(homes, bool), np.arange(homes, size)
    for seed in central(rows, head, size, homes):
        if left[seed]:
            left[seed] = False
            rest = np.flatnonzero(left)
            rest = rest[rows.near(head + seed, head + rest)]
            left[rest] = False
            rest = np.append(rest, others[rows.near(head + seed, head + others)][:1])
            yield np.full(len(rest), head + seed), head + rest


def near_pairs(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (one a home) that are near, and rows of dense buckets; of those, in which over DENSE pairs a row are near, only the leaders' pairs."""
    heads = np.flatnonzero(np.append(True, rows.bucket[1:] != rows.bucket[:-1]))
    sizes = np.diff(np.append(heads, len(rows.bucket)))
    owner = np.repeat(np.arange(len(heads)), sizes)
    small = (sizes <= SMALL)[owner]
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.flatnonzero(small[:-d] & rows.home[:-d] & (owner[d:] == owner[:-d]))
        i = i[rows.near(i, i + d)]
        ones.append(i)
        twos.append(i + d)
    dense = np.zeros(len(heads), bool)
    for k in np.flatnonzero(sizes > SMALL):
        head, size, found = heads[k], sizes[k], 0
        for i in range(head, head + int(rows.home[head : head + size].sum())):
            j = np.arange(i + 1, head + size)
            j = j[rows.near(i, j)]
            found += len(j)
            ones.append(np.full(len(j), i))
            twos.append(j)
            if found > DENSE * size:
                dense[k] = True
                break
    one, two = np.concatenate(ones), np.concatenate(twos)
    dense |= np.bincount(owner[one], minlength=len(heads)) > DENSE * sizes
    few = ~dense[owner[one]]
    # rows of small buckets that are near to none are left out
    alone = small.copy()
    alone[one] = alone[two] = False
    parts = [(one[few], two[few]), *(x for k in np.flatnonzero(dense) for x in leaders(rows, heads[k], sizes[k]))]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), np.flatnonzero(dense[owner] & ~alone)


def pairs_across(rows: Rows, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of near rows (one a home) of a bucket that lie in different groups; with ``most`` only each row's nearest ones."""
    heads = np.flatnonzero(np.append(True, rows.bucket[1:] != rows.bucket[:-1]))
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for head, end in zip(heads, np.append(heads[1:], len(rows.bucket)), strict=True):
        names, where, sizes = np.unique(rows.group[head:end], return_inverse=True, return_counts=True)
        few = where != sizes.argmax()  # those of the largest group are seen from the others
        for i in np.flatnonzero(few):
            j = np.flatnonzero((where != where[i]) & (rows.home[head:end] | rows.home[head + i]))
            j = j[(j > i) | ~few[j]]
            j = head + j[rows.near(head + i, head + j)]
            if most is not None and len(j) > most:
                j = j[np.argsort(np.bitwise_count(rows.fp[head + i] ^ rows.fp[j]).sum(-1), kind="stable")[:most]]
            ones.append(np.full(len(j), head + i))
            twos.append(j)
    return np.concatenate(ones), np.concatenate(twos), np.zeros(0, np.int64)


def in_buckets(entries: DataFrame, homes: DataFrame, compare: Callable[[Rows], tuple[np.ndarray, np.ndarray, np.ndarray]], wide: int = WIDE) -> DataFrame:
    """a and b of the pairs that ``compare`` finds in buckets of ``entries`` (bucket, home, node, n, fp of ``wide`` numbers, group), of which ``homes`` are home; of its dense rows a is the node, beside bucket and home."""
    crowded = homes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    packed = entries.select("bucket", "home", F.col("node").alias("id"), F.struct("n", "fp", "group").alias("data"))
    rows = dealt(packed, crowded, ["bucket"], BLOCK).select("bucket", "home", F.col("id").alias("node"), "data.n", "data.fp", "data.group")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, held, size
            parts = held if kept is None else [kept, *held]
            now = Rows(*(np.concatenate([getattr(x, f.name) for x in parts]) for f in fields(Rows)))
            one, two, dense = compare(now)
            kept, held, size = now.take(np.flatnonzero(now.home & (now.bucket == now.bucket[-1]))), [], 0  # the last bucket may go on
            a, b = now.node[one], now.node[two]
            nulls = pa.nulls(len(a), pa.int64()), pa.nulls(len(dense), pa.int64())
            pairs = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), nulls[0], pa.nulls(len(a), pa.bool_())]
            rest = [pa.array(now.node[dense]), nulls[1], pa.array(now.bucket[dense]), pa.array(now.home[dense])]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(pairs, rest, strict=True)], names=["a", "b", "bucket", "home"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3)]
            held.append(Rows(*columns, raw(batch.column(4))[0].view(np.uint64).reshape(-1, wide), batch.column(5).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield flush()
        if size:
            yield flush()
        give_back()

    together = rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("home"), "node")
    return together.mapInArrow(work, "a long, b long, bucket long, home boolean")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a and b of ``pairs`` whose ``sets`` (node, set) of shingles have Jaccard 4/5 at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_pylist() for i in (2, 3))
            common = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(one, two, strict=True)]
            ok = pa.array([72 * c >= 4 * (len(x) + len(y)) for c, x, y in zip(common, one, two, strict=True)], pa.bool_())  # lengths are in bytes
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    side = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return stored(both.mapInArrow(work, "a long, b long"))


def similar_groups(docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and component_id, the smallest key that links reach, of each row; links are texts whose sets of shingles have a Jaccard similarity of 4/5 or more.

    Candidates come by multi-index hashing of fingerprints of 192 bits, in twelve segments of 16 bits with balls of radius 1, at
    every size; their sets of shingles are then compared, so no link is false. Bits of a pair at similarity 0.8 differ with
    a chance of 0.15, so that it meets with one of 0.98, a more similar one more often. Buckets in which few pairs are near
    give all; a dense one gives those of its leaders and homes first, then, of the groups that this leaves, each row's nearest in
    other groups, and at last all pairs between two groups that are left, so a large group of near copies doesn't give all its pairs.
    Pairs across groups are left out beforehand where odd sketches of 1,024 bits show that the sets differ in more shingles than
    similarity 0.8 allows. That loses no link; it tells nearly all other pairs of up to 500 shingles, and fewer of longer texts.

    Defined cases: equal texts (by their md5) are one node, so are all without words, null ones among them; case of A-Z and
    spaces don't count; rows of equal ids may lie in several groups; a null id is the least of a group only where all are
    null; other columns are left out, whatever their names.
    """
    keyed = docs.select(F.col(key).alias("k"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("hash"), F.col(text).alias("t"))
    as_bytes = lambda each: [x.tobytes() for x in wide_fingerprints(each)]
    marked = stored(_sets(keyed, shingle, as_bytes, "fp").withColumn("hash", F.when(F.col("n") > 0, F.col("hash")).otherwise(F.lit(b""))))
    # written, so that the numbers given here hold
    nodes = stored(marked.groupBy("hash").agg(F.min("k").alias("least"), F.max("n").alias("n"), F.max("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()))
    texts = keyed.select("hash", "t")
    full = nodes.where("n > 0")
    found = stored(in_buckets(filed_wide(full).withColumn("group", F.col("node")), filed_wide(full, 0), near_pairs))
    tried = stored(found.where("bucket IS NULL").select("a", "b").distinct())
    # the sets of all that may be compared, from one shuffle of texts, as large at every size
    ends = [tried.select(F.col(c).alias("node")) for c in ("a", "b")]
    needed = found.where("bucket IS NOT NULL").select(F.col("a").alias("node")).unionByName(ends[0]).unionByName(ends[1]).distinct()
    needed = needed.join(nodes.select("node", "hash"), "node").hint("merge")
    sets = stored(_sets(texts.join(needed, "hash").dropDuplicates(["hash"]).select("node", "t"), shingle, lambda each: [x.tobytes() for x in each], "set").select("node", "set"))
    links = _verified(tried, sets)
    dense = found.where("bucket IS NOT NULL").select("bucket", "home", F.col("a").alias("node")).distinct()
    if not dense.isEmpty():
        marks = nodes.select("node", "n", "fp").join(sketched(sets), "node").select("node", "n", F.concat("fp", "sketch").alias("fp"))
        dense = stored(dense.join(marks, "node"))
        # nearest ones first: what they link needs no more pairs; then all that is left
        for most in (NEAREST, None):
            grouped = dense.join(components(links), "node", "left").withColumn("group", F.coalesce("component", "node"))
            grouped = stored(grouped.select("bucket", "home", "node", "n", "fp", "group"))
            more = in_buckets(grouped, grouped.where("home"), partial(pairs_across, most=most), WIDE + ODD_BITS // 64).select("a", "b").distinct()
            fresh = stored(more.join(tried, ["a", "b"], "left_anti"))
            links, tried = links.unionByName(_verified(fresh, sets)), tried.unionByName(fresh)
    roots = nodes.select("node", "hash", "least").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(roots.join(firsts, "component").select("hash", "component_id"))
    return marked.select("k", "hash").join(named, "hash").select(F.col("k").alias(key), "component_id")
