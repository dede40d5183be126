"""Hard-negative mining by a norm-bucketed search for largest inner products.

Components become integers, so that scores are exact. Candidates are sorted by norm: steps of about 1 % are counted, a step of
many rows is cut into parts, and each part of at most some ``BUCKET`` rows is one bucket, sorted by norm. Anchors are a stated
set of the rows; they are sorted by what their norm must be multiplied with to reach their lower limit, and packed into blocks.
By Cauchy-Schwarz a bucket holds nothing for a block whose ratio of limit and norm is above the bucket's largest norm: such
pairs of bucket and block are never made. The buckets of the largest norms are searched first, and their results raise the
limits for the others; within a task, which holds one block and streams a share of the buckets from the largest norms down,
each anchor's running last place raises its limit too.

Positives are the best rows of the anchor's label; each positive's score gives a window of scores, in which the best rows of
other labels are the negatives. Both are the same search, with one window or several for an anchor.

What the driver holds: the counts of steps (at most some 130,000), and one number for each block of anchors (at most ``BLOCKS``).

Defined cases: rows with a null id, label or vector, with a null or non-finite component, or with one that is non-finite
after scaling, take no part; shorter vectors count as filled up with zeros; an empty table gives no rows; rows of equal ids are
rows of their own, of which one isn't the other's self (an id that is an anchor twice gives its rows twice); ties go to the smaller
id; scores past 64 bits count as the nearest 64-bit number; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, raw, stored

#: Candidates of a bucket, anchors of a block, blocks at most (else they get larger), shares of the buckets.
BUCKET, BLOCK, BLOCKS, SHARES = 2048, 1024, 65_536, 32
#: Steps of norm for each doubling; the share of the candidates that is searched first.
STEPS, HEAD = 64, 16
#: Rounding of norms must not prune.
SLACK = 1 + 1e-9
LEAST, MOST = -(2**63) + 1, 2**63 - 1
PACKED = "level long, part int, top double, least double, blob binary"


def numbers(vec: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from vectors that travel as 2, 4 or 8 bytes a component."""
    data, ends = raw(vec)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width))
    for size, kind in ((2, "i2"), (4, "i4"), (8, "f8")):
        mine = np.flatnonzero(sizes == size * width)
        if len(mine) == len(sizes):
            return data.view(kind).reshape(-1, width).astype(np.float64)
        if len(mine):
            out[mine] = np.stack([data[ends[i] : ends[i + 1]].view(kind) for i in mine])
    return out


def whole_numbers(vectors: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: float) -> tuple[DataFrame, int]:
    """id, label, anchor, norm and vec (bytes of whole numbers) of the rows that take part; and the number of components."""
    width = max(1, vectors.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                lists = part.column(3)
                offsets = lists.offsets.to_numpy()
                sizes = np.diff(offsets)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                x = np.zeros((len(sizes), width))
                with np.errstate(over="ignore", invalid="ignore"):
                    # null components come as NaN
                    x[rows, places] = np.floor(scale * lists.values.to_numpy(zero_copy_only=False)[np.repeat(offsets[:-1], sizes) + places].astype(np.float64))
                good = np.isfinite(x).all(1)
                x = x[good]
                large = np.abs(x).max(1, initial=0)
                norm = np.where(large > 0, large * np.sqrt(((x / np.where(large > 0, large, 1)[:, None]) ** 2).sum(1)), 0)
                kinds = np.where(large < 2**15, 0, np.where(large < 2**31, 1, 2))
                vec = [row.astype(("i2", "i4", "f8")[k]).tobytes() for row, k in zip(x, kinds, strict=True)]
                kept = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(norm), pa.array(vec, pa.binary())], names=["id", "label", "anchor", "norm", "vec"])

    usable = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    usable = usable.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return usable.mapInArrow(work, "id long, label long, anchor boolean, norm double, vec binary"), width


def packed(rows: DataFrame, counts: dict[int, int], size: int, order: str) -> DataFrame:
    """``rows`` (level, norm, ratio, any others) as rows of about ``size`` of them, in order of ``order`` within: level, part, top (largest norm), least (smallest ratio) and blob."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(k, math.ceil(n / size)) for k, n in counts.items()], "level long, parts int")
    dealt = rows.join(F.broadcast(parts), "level").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "descending")])
        inner = table.drop_columns(["level", "part"]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, inner.schema) as out:
            out.write_table(inner)
        top, least = (np.asarray(inner.column(c)) for c in ("norm", "ratio"))
        return pa.table({"level": table.column("level")[:1], "part": table.column("part")[:1], "top": [float(top.max())], "least": [float(least.min())], "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return dealt.groupBy("level", "part").applyInArrow(pack, PACKED)


def level_of(x: Column) -> Column:
    """A number of at most some 130,000 that grows with x > 0; the least for others."""
    return F.when(x > 0, F.floor(F.log2(x) * STEPS)).otherwise(F.lit(-(10**6))).cast("long")


def level_counts(rows: DataFrame) -> dict[int, int]:
    return {r["level"]: r["n"] for r in rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}


def exact_scores(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """Inner products of whole numbers: in doubles where ``norms``, which bounds every sum, says that they are exact, else as whole numbers."""
    if norms < 2**53:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


class Search:
    """A block of anchors, and by anchor and window the best candidates so far."""

    def __init__(self, table: pa.Table, width: int, k: int, same: bool):
        self.k, self.same = k, same
        self.row, self.label, self.norm = (np.asarray(table.column(c)) for c in ("row", "label", "norm"))
        self.vec = numbers(table.column("vec"), width)
        self.low, self.high, self.need = (raw(table.column(c))[0].view(np.int64).reshape(len(self.row), -1) for c in ("low", "high", "need"))
        self.need = np.maximum(self.low, self.need)
        self.windows = self.low.shape[1]
        none = np.zeros(0, np.int64)
        self.best = (none, none, none, none)  # window of an anchor, score, id, row

    def look(self, table: pa.Table, width: int) -> None:
        """Take over what the bucket has for any window."""
        norm = np.asarray(table.column("norm"))
        open_ = self.low <= self.high
        lowest = np.where(open_, self.need, MOST).min(1)
        mine = np.flatnonzero(open_.any(1) & (lowest <= self.norm * norm.max() * SLACK))
        if not len(mine):
            return
        row, ids, label = (np.asarray(table.column(c)) for c in ("row", "id", "label"))
        scores = exact_scores(self.vec[mine], numbers(table.column("vec"), width), float(self.norm[mine].max() * norm.max()))
        right = self.label[mine][:, None] == label
        right = right & (self.row[mine][:, None] != row) if self.same else ~right
        found = []
        for w in range(self.windows):
            fit = right & (scores >= self.need[mine, w][:, None]) & (scores <= self.high[mine, w][:, None])
            if fit.sum() > 4 * self.k * len(mine) and scores.shape[1] > self.k:  # the bucket's own best are enough
                shown = np.where(fit, scores, LEAST)
                fit &= scores >= np.partition(shown, -self.k, axis=1)[:, -self.k][:, None]
            i, j = np.nonzero(fit)
            found.append((mine[i] * self.windows + w, scores[i, j].astype(np.int64), ids[j], row[j]))
        key, score, ids, row = (np.concatenate(x) for x in zip(self.best, *found, strict=True))
        order = np.lexsort((row, ids, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key, "left")
        order, key, place = order[place < self.k], key[place < self.k], place[place < self.k]
        self.best = (key, score[order], ids[order], row[order])
        last = np.flatnonzero(place == self.k - 1)
        flat = self.need.ravel()
        flat[key[last]] = np.maximum(flat[key[last]], self.best[1][last])

    def result(self) -> pa.RecordBatch:
        key, score, ids, row = self.best
        arrays = [pa.array(self.row[key // self.windows]), pa.array((key % self.windows).astype(np.int32)), pa.array(score), pa.array(ids), pa.array(row)]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "w", "score", "id", "other"])


def in_reach(buckets: DataFrame, limits: np.ndarray) -> DataFrame:
    """``buckets`` once for each ``block`` whose limit, of those in order, their largest norm reaches."""

    @F.pandas_udf("int")
    def reached(top: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, top.to_numpy() * SLACK, "right").astype(np.int32))

    return buckets.withColumn("n", reached("top")).where("n > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


FOUND = "row long, w int, score long, id long, other long"


def searched(anchors: DataFrame, buckets: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """By anchor and window the best ``k`` of each share of the buckets: row, w, score, id, other. ``anchors``: row, label, norm, vec, ratio, low, high, need."""
    anchors = stored(anchors.withColumn("level", level_of(F.col("ratio"))))
    counts = level_counts(anchors)
    size = max(BLOCK, math.ceil(sum(counts.values()) / BLOCKS))
    blocks = stored(packed(anchors, counts, size, "ratio"))
    known = sorted((r["least"], r["level"], r["part"]) for r in blocks.select("least", "level", "part").collect())
    limits = np.array([x[0] for x in known])
    names = anchors.sparkSession.createDataFrame([(level, part, n) for n, (_, level, part) in enumerate(known)], "level long, part int, block int")

    share = F.pmod(F.xxhash64("level", "part"), F.lit(SHARES)).cast("int")
    one = blocks.join(F.broadcast(names), ["level", "part"]).select("block", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(0.0).alias("top"), "blob")
    two = in_reach(buckets, limits).select("block", share.alias("share"), F.lit(1).alias("kind"), "top", "blob")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search = None, None
        for batch in batches:
            for block, part, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(4), strict=True):
                table = pa.ipc.open_stream(blob.as_buffer()).read_all()
                if kind == 0:
                    if search is not None:
                        yield search.result()
                    at, search = (block, part), Search(table, width, k, same)
                elif at == (block, part):
                    search.look(table, width)
        if search is not None:
            yield search.result()
        give_back()

    together = one.unionByName(two).repartition("block", "share").sortWithinPartitions("block", "share", "kind", F.desc("top"))
    return together.select("block", "share", "kind", "top", "blob").mapInArrow(work, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """row, w and best: the first ``k`` of all shares, by score and then id. A row's window has at most ``k`` from each share."""
    order = F.struct((-F.col("score")).alias("under"), "id", "other")
    return found.groupBy("row", "w").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))


def in_turns(anchors: DataFrame, turns: list[DataFrame], width: int, k: int, same: bool) -> DataFrame:
    """``best`` over the buckets of all turns, whose results raise the limits for the next. ``anchors``: row, label, norm, vec, low and high (bytes of whole numbers for windows)."""
    found = None
    for buckets in turns:
        if found is None:
            state = anchors.withColumn("need", F.col("low"))
        else:
            last = best(found, k).where(F.size("best") == k).select("row", "w", (-F.element_at("best", -1)["under"]).alias("at"))
            state = anchors.join(last.groupBy("row").agg(F.collect_list(F.struct("w", "at")).alias("reached")), "row", "left")
            state = state.mapInArrow(raised, "row long, label long, norm double, vec binary, low binary, high binary, need binary")
        now = stored(searched(with_ratio(state), buckets, width, k, same))
        found = now if found is None else found.unionByName(now)
    return best(found, k)


def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``need``: the lower limits, raised to the last places reached."""
    names = ["row", "label", "norm", "vec", "low", "high"]
    for batch in batches:
        need = []
        for low, reached in zip(batch.column("low").to_pylist(), batch.column("reached").to_pylist(), strict=True):
            limits = np.frombuffer(low, np.int64).copy()
            for x in reached or []:
                limits[x["w"]] = max(limits[x["w"]], x["at"])
            need.append(limits.tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(need, pa.binary())], names=[*names, "need"])


def with_ratio(state: DataFrame) -> DataFrame:
    """``ratio``: the norm that a candidate needs to reach the lowest limit of an open window; of an anchor of length zero none is needed, and none is enough where no window is open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, need = ([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("low", "high", "need"))
            least = np.array([min((float(n) for n, a, b in zip(*x, strict=True) if a <= b), default=math.inf) for x in zip(need, low, high, strict=True)])
            norm = batch.column("norm").to_numpy()
            ratio = np.where(least <= 0, 0.0, least / np.maximum(norm, 1e-300))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio)], names=[*batch.schema.names, "ratio"])

    names = ["row", "label", "norm", "vec", "low", "high", "need"]
    return state.select(*names).mapInArrow(work, "row long, label long, norm double, vec binary, low binary, high binary, need binary, ratio double")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row where ``anchors`` holds, and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels that score from ``low`` to ``high`` hundredths of the positive."""
    rows, width = whole_numbers(vectors, anchors, key, vector, label, scale)
    # written, so that the row numbers given here hold
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("level", level_of(F.col("norm"))).withColumn("ratio", F.lit(0.0)))
    counts = level_counts(rows)
    buckets = stored(packed(rows.drop("anchor"), counts, BUCKET, "norm"))
    chosen = stored(rows.where("anchor").select("row", "id", "label", "norm", "vec"))

    # the largest norms first: whole steps, and parts of the step in which the head ends
    left, edge, some = math.ceil(sum(counts.values()) / HEAD), None, 0
    for level in sorted(counts, reverse=True):
        if left <= 0:
            break
        edge, some = level, min(math.ceil(left / BUCKET), math.ceil(counts[level] / BUCKET))
        left -= counts[level]
    if edge is None:
        turns = [buckets]
    else:
        head = (F.col("level") > edge) | ((F.col("level") == edge) & (F.col("part") < some))
        turns = [buckets.where(head), buckets.where(~head)]

    def limits(a: int, b: int) -> list[Column]:
        return [F.lit(np.array([x], np.int64).tobytes()).alias(c) for c, x in (("low", a), ("high", b))]

    own = stored(in_turns(chosen.select("row", "label", "norm", "vec", *limits(LEAST, MOST)), turns, width, positives, same=True).select("row", "best"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for found in batch.column("best").to_pylist():
                scores = [-x["under"] for x in found]
                a = [-(-low * s // 100) for s in scores] + [1] * (positives - len(scores))
                b = [high * s // 100 for s in scores] + [0] * (positives - len(scores))
                lows.append(np.clip(np.array(a, object), LEAST, MOST).astype(np.int64).tobytes())
                highs.append(np.clip(np.array(b, object), LEAST, MOST).astype(np.int64).tobytes())
            names = ["row", "label", "norm", "vec"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], names=[*names, "low", "high"])

    aimed = stored(chosen.join(own, "row").select("row", "label", "norm", "vec", "best").mapInArrow(windows, "row long, label long, norm double, vec binary, low binary, high binary"))
    found = in_turns(aimed, turns, width, negatives, same=False).select("row", "w", F.posexplode("best").alias("place", "negative"))
    pairs = own.select("row", F.posexplode("best").alias("w", "positive")).join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
    return pairs.join(found, ["row", "w"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        (F.col("place") + 1).alias("rank"),
        F.col("negative.id").alias("negative_id"),
        (-F.col("positive.under")).alias("positive_score"),
        (-F.col("negative.under")).alias("negative_score"),
    )
