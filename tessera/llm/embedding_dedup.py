"""Near-duplicate embeddings by lattice hashing.

In each of several tables, eight random projections of a vector of length 1 are decoded to the nearest point of the lattice
E8, its cell. A vector is at home in its cell and looks up the neighbouring cells that it lies closest to; where two meet,
their cosine is verified in double precision. Links that meet give the components, by forests of links; within a component
all links are counted afterwards, block by block, as linked vectors always share one. Thus a component's links are found
even where their vectors met in no table, and no group gives all its pairs.

``PLAN`` is 10 tables with 12 lookups at every size, which meets a pair at cosine 0.95 with a chance over 0.999 (0.79 a table).
Cells in which over ``HOMES`` vectors are at home are cut into blocks that are buckets of their own, so a task holds one block.

Equal vectors are one node with a weight. Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; shorter vectors count as filled up with zeros; components of any
finite size count; rows of equal ids are vectors of their own; a null id's row is kept, and is the least of a component only
where all its ids are null; other columns are left out, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.buckets import connect, dealt
from tessera.llm.common import raw, stored
from tessera.llm.components import components
from tessera.llm.words import mix

THRESHOLD = 0.95
#: Vectors of a component that are compared with as many others at a time; rows read before their links are counted.
BLOCK, CHUNK = 2048, 8192
SEED = 20_24
#: Tables, lookups in each, and the projections' scale; homes of a bucket.
PLAN, HOMES = (10, 12, 0.8), 20_000


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum."""
    out = np.rint(x)
    rest = x - out
    odd = np.flatnonzero(out.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    out[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: D8 or D8 moved by halves."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def shortest() -> np.ndarray:
    """E8's 240 shortest vectors, which lead to a cell's neighbours."""
    signs = itertools.product((1.0, -1.0), repeat=2)
    two = [np.bincount([i, j], (a, b), 8) for a, b in signs for i, j in itertools.combinations(range(8), 2)]
    halves = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array([*two, *halves])


def cell_ids(cells: np.ndarray, table: int) -> np.ndarray:
    """A number for each lattice point of a table."""
    out = np.full(cells.shape[:-1], table, np.uint64)
    for i in range(8):
        out = mix(out + (2 * cells[..., i]).astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def filings(vectors: np.ndarray, tables: int, lookups: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """By vector and table: the cells, own first and then the neighbours in order of nearness; and which are own."""
    size, ways = vectors.shape[1], shortest()
    out = np.zeros((len(vectors), tables, 1 + lookups), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, size])
        x = vectors @ rng.normal(0, scale, (size, 8)) + rng.uniform(0, 1, 8)
        own = nearest_e8(x)
        near = np.argsort(-((x - own) @ ways.T), axis=1, kind="stable")[:, :lookups]  # all are as long, so nearest is most along
        out[:, t] = cell_ids(np.concatenate([own[:, None], own[:, None] + ways[near]], axis=1), t)
    home = np.zeros(out.shape, bool)
    home[:, :, 0] = True
    return out, home


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of doubles from vectors as bytes of ``kind`` numbers."""
    data, _ = raw(column)
    return data.view(kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def number_kind(vectors: DataFrame, vector: str) -> str:
    """How components travel: as they are if floats, else as doubles."""
    return "f4" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) or vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), False) else "f8"


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec (numbers of number_kind as bytes; null for what can't link) of each row."""
    id_type, kind = vectors.schema[key].dataType.simpleString(), number_kind(vectors, vector)
    width = vectors.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                lists = part.column(1)
                offsets = lists.offsets.to_numpy()
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
                flat = lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
                rows = np.repeat(np.arange(len(sizes)), sizes)
                places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out = np.zeros((len(sizes), max(width, 1)), kind)
                out[rows, places] = flat[np.repeat(offsets[:-1], sizes) + places] + 0.0
                good = np.isfinite(out).all(1) & (out != 0).any(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() if g else None for x, g in zip(out, good, strict=True)], pa.binary())], names=["id", "vec"])

    kept = F.col(vector) if kind == "f4" else F.col(vector).cast("array<double>")
    return vectors.select(F.col(key).alias("id"), kept.alias("v")).mapInArrow(work, f"id {id_type}, vec binary")


def file_cells(nodes: DataFrame, kind: str, tables: int, lookups: int, scale: float) -> DataFrame:
    """``nodes`` (node, vec) in their cells: bucket, home, id, data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                cells, home = filings(_unit(_matrix(rows.column(1), kind)), tables, lookups, scale)
                each = pa.array(np.repeat(np.arange(rows.num_rows), cells[0].size))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(home.ravel()), rows.column(0).take(each), rows.column(1).take(each)], names=["bucket", "home", "id", "data"])

    return nodes.select("node", "vec").mapInArrow(work, "bucket long, home boolean, id long, data binary")


def near_vectors(threshold: float):
    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.einsum("...i,...i", x, y) >= threshold

    return near


def count_links(grouped: DataFrame, kind: str, threshold: float) -> DataFrame:
    """node and links: by node of ``grouped`` (component, node, vec, weight), the weights of the others at the threshold in its component."""
    sizes = grouped.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y")))
    dealt = grouped.join(sizes, "component").withColumn("side", mine).withColumn("p", F.explode(pairs))

    def count(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(c).to_numpy() for c in ("component", "x", "y")]
        side, node, weight = (rows.column(c).to_numpy() for c in ("side", "node", "weight"))
        vec = rows.column("vec").combine_chunks()
        links = np.zeros(len(node), np.int64)
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        heads = np.append(np.flatnonzero(np.append(True, new)), len(node))
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            unit = _unit(_matrix(vec.slice(a, b - a), kind))
            if keys[1][a] == keys[2][a]:
                near = unit @ unit.T >= threshold
                np.fill_diagonal(near, False)
                links[a:b] = near @ weight[a:b]
            else:
                one = side[a:b] == keys[1][a]
                near = unit[one] @ unit[~one].T >= threshold
                links[a:b][one] = near @ weight[a:b][~one]
                links[a:b][~one] = near.T @ weight[a:b][one]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= CHUNK:
                keys = np.stack([held.column(c).to_numpy() for c in ("component", "x", "y")])
                cut = np.flatnonzero((keys != keys[:, -1:]).any(0))
                if len(cut):  # the last group may go on; none has over two blocks
                    yield count(held.slice(0, cut[-1] + 1))
                    held = held.slice(cut[-1] + 1)
        if held is not None and held.num_rows:
            yield count(held)

    together = dealt.select("component", "p.x", "p.y", "side", "node", "weight", "vec").repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return together.mapInArrow(work, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, n_links (other vectors linked), component_id (smallest id reached) and kept (whether that is its own) of each row."""
    rows, kind = clean(vectors, key, vector), number_kind(vectors, vector)
    usable = rows.where(F.col("vec").isNotNull())
    # written, so that the numbers given here hold
    nodes = stored(usable.groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    tables, lookups, scale = PLAN
    crowded = file_cells(nodes, kind, tables, 0, scale).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOMES)
    cells = dealt(file_cells(nodes, kind, *PLAN), crowded, ["bucket"], HOMES)
    found = components(connect(cells, near_vectors(threshold), lambda column: _unit(_matrix(column, kind))))
    linked = found.select("node", "component").unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    grouped = stored(nodes.join(linked, "node"))
    links = count_links(grouped, kind, threshold)
    firsts = grouped.groupBy("component").agg(F.min("first").alias("reached"))
    known = grouped.select("node", "component").join(firsts, "component").join(links, "node").select("node", "reached", "links")
    named = nodes.join(known, "node", "left").select("vec", F.coalesce("reached", "first").alias("reached"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = rows.join(named, "vec", "left")
    component = F.coalesce("reached", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
