"""Buckets in which rows at home are compared with each other and with rows that look them up.

A bucket of few rows gives its links; a larger one a forest of them, so that what comes out never is more than a few
times what went in, while all that its links connect stays connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Rows of a bucket whose links are all listed; rows looked at together.
SMALL, CHUNK = 24, 100_000
#: Crowded keys (of some 30 bytes each) that may be broadcast.
BROADCAST = 100_000

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def forest(data: np.ndarray, homes: int, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links (as row numbers) that connect what links among the first ``homes`` rows, and from them to the others, connect."""
    left, froms, tos = np.ones(len(data), bool), [], []
    for seed in range(homes):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left if x < homes else left[:homes])
            if not len(rest):
                break
            found = rest[near(data[rest], data[x])]
            left[found] = False
            froms.append(np.full(len(found), x))
            tos.append(found)
            queue += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (none, none)


def bucket_links(bucket: np.ndarray, home: np.ndarray, data: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links, as row numbers, of rows that lie sorted by bucket, homes first."""
    if not len(bucket):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(heads, len(bucket)))
    small = np.repeat(sizes <= SMALL, sizes)
    froms, tos = [], []
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.flatnonzero(small[:-d] & home[:-d] & (bucket[d:] == bucket[:-d]))
        i = i[near(data[i], data[i + d])]
        froms.append(i)
        tos.append(i + d)
    for head, size in zip(heads[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        one, two = forest(data[head : head + size], int(home[head : head + size].sum()), near)
        froms.append(one + head)
        tos.append(two + head)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(froms or none), np.concatenate(tos or none)


def dealt(rows: DataFrame, crowded: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``rows`` (``keys``, home, id, data) in buckets that hold about ``block`` homes; of ``crowded`` keys (n, their homes) each block of homes is a bucket, in which later blocks' homes look up too.

    Crowded keys are counted first: as few as usual they are broadcast, so that ``rows`` are shuffled once only.
    """
    crowded = stored(crowded)
    if crowded.limit(BROADCAST + 1).count() <= BROADCAST:
        crowded = F.broadcast(crowded)
    blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (
        rows.join(crowded, keys, "left")
        .withColumn("blocks", blocks)
        .withColumn("block", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), mine)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select(F.xxhash64(*keys, "block").alias("bucket"), (F.col("home") & (F.col("block") == mine)).alias("home"), "id", "data")
    )


def connect(rows: DataFrame, near: Near, decode: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """a and b of links found in the buckets of ``rows`` (bucket long, home boolean, id long, data); homes of a bucket must fit in a task, lookups pass in chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, n = None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, held, n
            parts = held if kept is None else [kept, *held]
            bucket, home, ids, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            one, two = bucket_links(bucket, home, data, near)
            stay = home & (bucket == bucket[-1])  # the last bucket may go on
            kept, held, n = (bucket[stay], home[stay], ids[stay], data[stay]), [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array(ids[two])], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), decode(batch.column(3))))
            n += batch.num_rows
            if n >= CHUNK:
                yield flush()
        if n:
            yield flush()

    together = rows.select("bucket", "home", "id", "data").repartition("bucket").sortWithinPartitions("bucket", F.desc("home"))
    return together.mapInArrow(work, "a long, b long")
