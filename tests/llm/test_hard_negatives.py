"""Hard negatives against brute force in whole numbers: norms of many sizes, ties, nulls, repeated ids, huge components, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H
from tessera.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95, every=10):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), label))
    out = []
    for n, (a, va, la) in enumerate(kept):
        if a % every:
            continue
        others = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(va, v, strict=True)))), i, label) for m, (i, v, label) in enumerate(kept) if m != n]
        near = sorted((x for x in others if x[2] == la), key=lambda x: (-x[0], x[1]))[:positives]
        for score, p, _ in near:
            fit = sorted((x for x in others if x[2] != la and low * score <= 100 * x[0] <= high * score), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(a, p, r, i, score, s) for r, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed=1, n=400, size=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        length = rng.choice([0, 0.01, 0.3, 1, 1, 1, 5, 80])
        v = [round(rng.gauss(0, 1) * length, rng.choice([0, 2, 4])) for _ in range(rng.choice([size, size, size - 1]))]
        rows.append((i, rng.choice(rows)[1] if i and rng.random() < 0.2 else v, rng.choice([0, 0, 0, 1, 2, 3])))
    odd = [(None, [1.0] * size, 1), (1000, None, 1), (1001, [1.0] * size, None), (1010, [float("nan")] + [1.0] * (size - 1), 1), (1020, [None] + [1.0] * (size - 1), 1)]
    return rows + odd + [(1030, [float("inf")] * size, 1), (1040, [], 2), (1050, [1e307] * size, 1), (-50, [0.5] * size, 9), (-7, [0.5] * size, 9)]


def test_equals_brute_force(spark):
    rows = vectors()
    assert len(want := brute(rows)) > 200
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clashing = frame.withColumns({c: F.lit(1) for c in ("id", "row", "norm", "level", "part", "best", "w", "score", "anchor", "ratio", "need")})
    got = H.hard_negatives(clashing, F.col("vec_id") % 10 == 0)
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    assert found(got) == want


def test_small_buckets_blocks_and_other_counts(spark, monkeypatch):
    for name, n in (("BUCKET", 7), ("BLOCK", 3), ("SHARES", 4), ("HEAD", 5)):
        monkeypatch.setattr(H, name, n)
    rows = vectors(2, 300)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(H.hard_negatives(frame, F.col("vec_id") % 10 == 0, positives=3, negatives=2, low=20, high=120)) == brute(rows, 3, 2, 20, 120)


def test_few_labels_ties_and_scores_past_64_bits(spark):
    huge = [(i, [3e17 * (1 + i % 3), -2e17, float(i)], i % 2) for i in range(0, 40)] + [(i, [1e200, -1e200, 0.0], i % 2) for i in range(40, 46)]
    same = [(i, [0.5, 0.5, 0.25 * (i % 2)], i % 3) for i in range(60)]
    alone = [(0, [1.0], 0), (10, [0.75], 1), (20, [0.7], 2)]
    for rows in (huge, same, alone):
        assert found(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (11, [0.9, 0.5], 1), (12, [0.6, 0.4], 2), (12, [0.6, 0.4], 2), (13, [0.5, 0.4], 3)]
    assert found(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == brute(rows)


def test_empty(spark):
    assert found(H.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)) == []
    assert found(H.hard_negatives(spark.createDataFrame([(10, [], 1), (20, None, 1)], SCHEMA), F.col("vec_id") % 10 == 0)) == []


def test_buckets_out_of_reach_are_never_made(spark):
    tops = [0.0, 0.5, 1.0, 4.0, 4.0]
    limits = np.array([0.0, 0.0, 1.0, 3.9, 5.0])
    made = H.in_reach(spark.createDataFrame([(t, n) for n, t in enumerate(tops)], "top double, part int"), limits)
    assert sorted((r.part, r.block) for r in made.collect()) == [(n, b) for n, t in enumerate(tops) for b in range(5) if limits[b] <= t]


def test_a_block_skips_anchors_that_the_norms_cannot_serve():
    """Once an anchor's last place is above what a bucket's norms allow, nothing of the bucket is compared with it."""
    import pyarrow as pa

    bytes_of = lambda x, kind: pa.array([r.astype(kind).tobytes() for r in x], pa.binary())
    x = np.array([[100, 0], [90, 0], [3, 0], [2, 0]])
    table = pa.table({"row": [0, 1, 2, 3], "id": [0, 1, 2, 3], "label": [0] * 4, "norm": np.linalg.norm(x, axis=1), "vec": bytes_of(x, "i2")})
    limits = np.array([[H.LEAST]])
    block = table.slice(0, 1).append_column("low", bytes_of(limits, "i8")).append_column("high", bytes_of(-limits, "i8")).append_column("need", bytes_of(limits, "i8"))
    search = H.Search(block, 2, 1, True)
    search.look(table.slice(1, 1), 2)
    assert search.need.tolist() == [[9000]]
    seen = []
    search.vec = type("Spy", (), {"__getitem__": lambda self, i: seen.append(i)})()
    search.look(table.slice(2, 2), 2)
    assert not seen


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    got = found(Q.op11_hard_negatives(spark, f"/root/testdata/{sf}"))
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert got == sorted(con.execute(f"SELECT {names} FROM ({Q.ORACLES['op11_hard_negatives']})").fetchall()) and got
