"""Models fitted by sums over all rows: each step is one pass in which every task adds up its rows' part of the gradient.

Rows are packed into blocks of numbers, written once and kept in memory or on disk by the tasks that read them (at most ``HERE`` bytes of them: by the driver); what a step sends is the weights
and what comes back is a sum of their size, from each task by way of a tree. The driver holds weights only. Lost blocks are read again.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Rows of a block; partitions whose sums the driver adds up itself; bytes of blocks for a task, as a step is short; bytes of blocks that
#: the driver goes through itself, as a job for each of thousands of steps takes longer than a few MB of sums; bytes of batches that a task
#: steps through in a row; epochs after which what was dealt is let go.
BLOCK, FEW, TASK, HERE, RUN, LET_GO = 4096, 64, 8_000_000, 8_000_000, 16_000_000, 8

Block = dict[str, np.ndarray]


def blocks(frame: DataFrame, heavy: int = 1) -> RDD | list[Block]:
    """``frame``, whose columns are numbers or arrays of equally many numbers, as arrays of at most BLOCK rows by column. Where a byte is more work, ``heavy`` times fewer go to a task."""
    names = frame.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                sink = pa.BufferOutputStream()
                part = batch.slice(a, BLOCK)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    def unpack(row) -> Block:
        part = pa.ipc.open_stream(row.block).read_all().combine_chunks()
        out = {}
        for name in names:
            column = part.column(name).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            listed = pa.types.is_list(column.type)
            out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if listed else column.to_numpy(zero_copy_only=False)
        return out

    packed = written(frame.mapInArrow(pack, "block binary"))
    size = packed.agg(F.sum(F.octet_length("block")).alias("n")).first()["n"] or 0
    if size <= HERE:
        return [unpack(row) for row in packed.collect()]
    return packed.repartition(math.ceil(size * heavy / TASK)).rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def released(data: RDD | list[Block]) -> None:
    if not isinstance(data, list):
        data.unpersist()


def total(data: RDD | list[Block], part: Callable[[Block], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sums of what ``part`` gives of each block; None without blocks."""

    def of_task(found: Iterator[Block]) -> Iterator[list[np.ndarray]]:
        sums = None
        for block in found:
            mine = part(block)
            sums = mine if sums is None else [a + b for a, b in zip(sums, mine, strict=True)]
        if sums is not None:
            yield sums

    add = lambda x, y: y if x is None else x if y is None else [a + b for a, b in zip(x, y, strict=True)]
    if isinstance(data, list):
        return next(of_task(iter(data)), None)
    sums = data.mapPartitions(of_task)
    if data.getNumPartitions() > FEW:
        return sums.treeAggregate(None, add, add)
    out = None
    for x in sums.collect():  # one a task, at most FEW
        out = add(out, x)
    return out


def fit_logistic(rows: DataFrame, n_features: int, sets: list[list[int]], n_folds: int, epochs: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, biases, means and deviations of a model for each set of features and fold, in that order, fitted on the other folds by full gradient steps from zero; the bias isn't penalised.

    ``rows``: x (array of doubles, null where missing), y (0 or 1), fold. A set's models leave out rows that lack one of its features; features
    are standardised by the rows that a model is fitted on (population deviation, 1 where it is tiny).
    """
    data = blocks(rows.select(F.col("x").cast("array<double>"), F.col("y").cast("double"), F.col("fold").cast("int")), heavy=4)
    uses = np.zeros((len(sets) * n_folds, n_features), bool)
    for s, features in enumerate(sets):
        uses[s * n_folds : (s + 1) * n_folds, features] = True
    held = np.tile(np.arange(n_folds), len(sets))

    def seen(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Features, missing ones as 0, and by row and model whether the row counts."""
        x = block["x"]
        missing = np.isnan(x)
        whole = ~((missing.astype(float) @ uses.T) > 0)
        return np.where(missing, 0, x), (whole & (block["fold"][:, None] != held)).astype(float)

    def first(block: Block) -> list[np.ndarray]:
        x, on = seen(block)
        return [on.sum(0), on.T @ x]

    sums = total(data, first)
    if sums is None:
        sums = [np.zeros(len(uses)), np.zeros(uses.shape)]
    n = np.maximum(sums[0], 1)
    mean = np.where(uses, sums[1] / n[:, None], 0)
    middle = mean[sums[0] > 0].mean(0) if (sums[0] > 0).any() else np.zeros(n_features)

    def second(block: Block) -> list[np.ndarray]:
        x, on = seen(block)
        return [np.stack([on[:, m] @ (x - mean[m]) ** 2 for m in range(len(mean))])]

    spread = np.sqrt((total(data, second) or [np.zeros(uses.shape)])[0] / n[:, None])
    spread = np.where(uses & (spread >= 1e-8), spread, 1)
    weights, bias = np.zeros(uses.shape), np.zeros(len(uses))

    def ready(block: Block) -> Block:
        """What a step needs of a block, worked out once: features from the middle, so that little is lost in the differences below, and the models' rows."""
        x, on = seen(block)
        x = x - middle
        return {"x": x, "by_feature": np.ascontiguousarray(x.T), "on": np.ascontiguousarray(on.T > 0), "y": block["y"]}

    rows_of = [ready(block) for block in data] if isinstance(data, list) else data.map(ready).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(epochs):
        slope = weights / spread
        shift = bias - (slope * (mean - middle)).sum(1)

        def step(block: Block, slope=slope, shift=shift) -> list[np.ndarray]:
            gap = -slope @ block["by_feature"]  # a row a model, in place from here on
            gap -= shift[:, None]
            np.clip(gap, -40, 40, out=gap)
            np.exp(gap, out=gap)
            gap += 1
            np.reciprocal(gap, out=gap)
            gap -= block["y"]
            gap *= block["on"]
            return [gap @ block["x"], gap.sum(1)]

        sums = total(rows_of, step)
        if sums is None:
            break
        gradient = np.where(uses, (sums[0] - sums[1][:, None] * (mean - middle)) / spread / n[:, None], 0)
        weights = weights - rate * (gradient + penalty * weights)
        bias = bias - rate * sums[1] / n
    released(rows_of)
    released(data)
    return weights, bias, mean, spread


def batch_of(number: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """Which of an epoch's batches a row is in, by its number and the seed: another deal each epoch."""
    x = number.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 1_000_003 + epoch) & 0xFFFFFFFF)
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return ((x >> np.uint64(33)) % np.uint64(max(batches, 1))).astype(np.int64)


class Softmax:
    """A linear softmax model's rows: shares by class, and their part of the gradient."""

    @staticmethod
    def logits(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return x @ weights.T + bias

    @staticmethod
    def shares(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class State:
    """A model on its way by AdamW: weights and bias, the means and squares of their slopes, and the steps taken."""

    weights: np.ndarray
    bias: np.ndarray
    means: tuple = (0.0, 0.0)
    squares: tuple = (0.0, 0.0)
    taken: int = 0

    def slopes(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over rows."""
        gap = Softmax.shares(Softmax.logits(x, self.weights, self.bias))
        gap[np.arange(len(x)), label] -= 1
        return gap.T @ x, gap.sum(0)

    def moved(self, of_w: np.ndarray, of_b: np.ndarray, rate: float, decay: float) -> State:
        t = self.taken + 1
        means = tuple(0.9 * m + 0.1 * g for m, g in zip(self.means, (of_w, of_b), strict=True))
        squares = tuple(0.999 * v + 0.001 * g**2 for v, g in zip(self.squares, (of_w, of_b), strict=True))
        new = [p * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) for p, m, v in zip((self.weights, self.bias), means, squares, strict=True)]
        return State(*new, means, squares, t)

    def after(self, x: np.ndarray, label: np.ndarray, rate: float, decay: float) -> State:
        """One step on a batch."""
        return self.moved(*(g / len(x) for g in self.slopes(x, label)), rate, decay)


def fit_softmax(rows: DataFrame, size: int, classes: int, groups: int, epochs: int = 80, rate: float = 1e-3, decay: float = 1e-2, batch: int = 512, seed: int = 17) -> dict[str, np.ndarray]:
    """A linear softmax model for each group, by AdamW over seeded batches; of all epochs the first with the most right answers on the validation rows counts.

    ``rows``: group and label (from 0), x (array of ``size`` doubles), part (0 train, 1 validation), number (a long that tells a group's rows apart). Features are
    standardised by the training rows (sample deviation, at least 1e-6). An epoch deals the rows to runs of batches of about ``batch``; a task steps through one run
    (about ``RUN`` bytes) of a group and hands the model on, so an epoch is one pass however many steps it has. Where a run can't hold a batch, each step is a pass
    over all blocks. Gives weights, bias, mean, spread and epoch (0: none was better than another) by group.
    """
    data = blocks(rows.select(F.col("group").cast("int"), F.col("label").cast("int"), F.col("x").cast("array<double>"), F.col("part").cast("int"), F.col("number").cast("long")))

    def by_group(block: Block, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for g in np.unique(block["group"][mask]):
            yield int(g), np.flatnonzero(mask & (block["group"] == g))

    def first(block: Block) -> list[np.ndarray]:
        n, sums = np.zeros(groups), np.zeros((groups, size))
        for g, i in by_group(block, block["part"] == 0):
            n[g] += len(i)
            sums[g] += block["x"][i].sum(0)
        return [n, sums]

    sums = total(data, first) or [np.zeros(groups), np.zeros((groups, size))]
    n, mean = sums[0], sums[1] / np.maximum(sums[0], 1)[:, None]

    def second(block: Block) -> list[np.ndarray]:
        out = np.zeros((groups, size))
        for g, i in by_group(block, block["part"] == 0):
            out[g] += ((block["x"][i] - mean[g]) ** 2).sum(0)
        return [out]

    spread = np.maximum(np.sqrt((total(data, second) or [np.zeros((groups, size))])[0] / np.maximum(n - 1, 1)[:, None]), 1e-6)
    rng, edge = np.random.default_rng(seed), 1 / np.sqrt(size)
    weights, bias = (np.repeat(rng.uniform(-edge, edge, (1, *shape)), groups, 0) for shape in ((classes, size), (classes,)))  # all groups start alike
    states = [State(weights[g].copy(), bias[g].copy()) for g in range(groups)]
    batches = np.maximum(np.ceil(n / batch).astype(int), 1)
    each = max(RUN // (8 * size * max(batch, 1)), 1)  # steps of a run
    runs = -(-batches // each)
    best, right = {"weights": weights.copy(), "bias": bias.copy(), "epoch": np.zeros(groups, int)}, np.full(groups, -1.0)

    def deal(block: Block, epoch: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """A block's training rows by run and group: steps, numbers, labels and features, in single precision where that is the same."""
        for g, i in by_group(block, block["part"] == 0):
            steps = batch_of(block["number"][i], seed, epoch, batches[g])
            for r in np.unique(steps // each):
                on = steps // each == r
                x = block["x"][i[on]]
                short = x.astype(np.float32)
                yield int(r) * groups + g, (steps[on], block["number"][i[on]], block["label"][i[on]], short if np.array_equal(short, x, equal_nan=True) else x)

    def through(parts: list[tuple[np.ndarray, ...]], g: int, state: State) -> State:
        """The state after a run's steps, rows of a step in order of number."""
        steps, number, label, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((number, steps))
        for i in np.split(order, np.flatnonzero(np.diff(steps[order])) + 1):
            state = state.after((x[i] - mean[g]) / spread[g], label[i], rate, decay)
        return state

    whole = 8 * size * batch <= RUN  # whether a task may hold a batch
    for epoch in range(1, epochs + 1):
        if isinstance(data, list) and whole:
            dealt: dict[int, list] = {}
            for block in data:
                for key, rows_of in deal(block, epoch):
                    dealt.setdefault(key, []).append(rows_of)
            for key in sorted(dealt):
                states[key % groups] = through(dealt.pop(key), key % groups, states[key % groups])
        elif whole:
            # each run of a group is a partition; a job goes through a run of all groups, and models go from one to the next
            laid = data.flatMap(lambda block, epoch=epoch: deal(block, epoch)).partitionBy(int(runs.max(initial=1)) * groups, int)
            for r in range(int(runs.max(initial=0))):
                now = [r * groups + g for g in range(groups) if r < runs[g]]

                def walk(found: Iterator, states=tuple(states)) -> Iterator[tuple[int, State]]:
                    parts = list(found)
                    if parts:
                        g = parts[0][0] % groups
                        yield g, through([p for _, p in parts], g, states[g])

                for g, state in data.context.runJob(laid, walk, now):
                    states[g] = state
            if epoch % LET_GO == 0:
                del laid, walk
                gc.collect()
                data.context._jvm.System.gc()  # Spark lets go of shuffles that nothing names any more
        for step in range(0 if whole else int(batches.max(initial=1))):

            def gradient(block: Block, states=tuple(states), epoch=epoch, step=step) -> list[np.ndarray]:
                of_w, of_b, count = np.zeros_like(weights), np.zeros_like(bias), np.zeros(groups)
                for g, i in by_group(block, block["part"] == 0):
                    i = i[batch_of(block["number"][i], seed, epoch, batches[g]) == step]
                    if len(i):
                        w, b = states[g].slopes((block["x"][i] - mean[g]) / spread[g], block["label"][i])
                        of_w[g] += w
                        of_b[g] += b
                        count[g] += len(i)
                return [of_w, of_b, count]

            sums = total(data, gradient)
            if sums is None:
                break
            for g in np.flatnonzero(sums[2]):
                states[g] = states[g].moved(sums[0][g] / sums[2][g], sums[1][g] / sums[2][g], rate, decay)
        weights, bias = (np.stack([getattr(s, name) for s in states]) if groups else x for name, x in (("weights", weights), ("bias", bias)))

        def hits(block: Block, weights=weights, bias=bias) -> list[np.ndarray]:
            out = np.zeros((2, groups))
            for g, i in by_group(block, block["part"] == 1):
                said = Softmax.logits((block["x"][i] - mean[g]) / spread[g], weights[g], bias[g]).argmax(1)
                out[0, g] += (said == block["label"][i]).sum()
                out[1, g] += len(i)
            return [out]

        found = (total(data, hits) or [np.zeros((2, groups))])[0]
        share = np.where(found[1] > 0, found[0] / np.maximum(found[1], 1), 0.0)
        better = share > right
        right = np.where(better, share, right)
        best["weights"][better], best["bias"][better], best["epoch"][better] = weights[better], bias[better], epoch
    released(data)
    return best | {"mean": mean, "spread": spread}
