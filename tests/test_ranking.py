"""Places within groups of any size: against Python, and that no task gets a group that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import auditing, rows, splits, summaries
from tessera.operators.ranking import placed


@pytest.fixture(scope="module")
def skewed(spark):
    """A group holds two thirds of the rows, all scores different but for a few; a null group."""
    rng = random.Random(11)
    data = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5]) if i % 5 else rng.random(), rng.random() < 0.3) for i in range(6000)]
    return data, spark.createDataFrame(data, "id long, g string, score double, label boolean").repartition(7)


def test_places_sizes_and_sums(skewed):
    data, frame = skewed
    got = {r.id: r for r in placed(frame, ["g"], [F.desc("score"), F.asc("id")], size="n", before={"earlier": F.col("id")}, sums={"all": F.col("id")}).collect()}
    assert len(got) == len(data)
    for g in ("hot", "a", "b", None):
        mine = sorted((r for r in data if r[1] == g), key=lambda r: (-r[2], r[0]))
        run = 0
        for place, r in enumerate(mine, 1):
            x = got[r[0]]
            assert (x.place, x.n, x.earlier, x["all"]) == (place, len(mine), run, sum(m[0] for m in mine))
            run += r[0]


def test_no_range_holds_the_large_group(spark, skewed):
    _, frame = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        laid = placed(frame, ["g"], [F.asc("score"), F.asc("id")], before={"b": F.lit(1)})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # over rows only within a range; over groups only on the summary, above the aggregate
    assert windows and all("_range#" in line or "_first#" in line or "sum(" in line for line in windows)
    sizes = spark.read.parquet(*laid.inputFiles()).groupBy("g", F.shiftright("_at", 33)).count()
    assert sizes.agg(F.max("count")).first()[0] < 0.5 * frame.where("g = 'hot'").count()


def test_metrics_of_a_large_group(skewed):
    data, frame = skewed
    roc = {r.g: r.auroc for r in M.auroc(frame, ["g"]).collect()}
    ap = {r.g: r.average_precision for r in M.average_precision(frame, ["g"], "id").collect()}
    for g in ("hot", "a"):
        mine = [r for r in data if r[1] == g]
        pos, neg = [r[2] for r in mine if r[3]], [r[2] for r in mine if not r[3]]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert roc[g] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
        hits, shares = 0, []
        for i, r in enumerate(sorted(mine, key=lambda r: (-r[2], r[0])), 1):
            if r[3]:
                hits += 1
                shares.append(hits / i)
        assert ap[g] == pytest.approx(sum(shares) / len(shares), abs=1e-12)
    got = {r.g: r for r in M.profile(frame.where("g IS NOT NULL"), ["g"], "score", {"p50": 0.5, "p99": 0.99}).collect()}
    values = sorted(r[2] for r in data if r[1] == "hot")
    assert (got["hot"].n, got["hot"].p50, got["hot"].p99) == (len(values), values[len(values) // 2], values[int(len(values) * 0.99)])


def test_splits_folds_donors_and_gates_of_a_large_group(skewed):
    data, frame = skewed
    sizes = {(r.g, r.split): r["count"] for r in splits.stratified(frame, "g", "id", "s").groupBy("g", "split").count().collect()}
    n = sum(r[1] == "hot" for r in data)
    assert sizes["hot", "train"] == round(0.8 * n) and sizes["hot", "val"] == round(0.1 * n)
    folds = {(r.g, r.fold): r["count"] for r in splits.folds(frame, "g", "id", 5, "s").groupBy("g", "fold").count().collect()}
    assert max(folds["hot", i] for i in range(5)) - min(folds["hot", i] for i in range(5)) <= 1
    donors = rows.with_mismatched_donor(frame.select("id", "g").na.fill("none"), "id", "g", "s").collect()
    assert len(donors) == len(data) and all(r.donor_g != r.g for r in donors)
    found = auditing.gate(auditing.violations(frame, "id", {"low": F.col("score") > 0.9}), 40).first()
    broken = sorted(r[0] for r in data if r[2] > 0.9)
    assert (found.n_violations, found.first_keys) == (len(broken), broken[:40])
    assert {r.fold for r in summaries.group_folds(frame, "g", 2, "s").where("g = 'hot'").select("fold").distinct().collect()} <= {0, 1}
    assert summaries.held_out_bases(frame, "id", "s", 0.25).where("split = 'val'").count() == len(data) // 4


def test_empty(spark, skewed):
    none = skewed[1].limit(0)
    assert placed(none, ["g"], [F.asc("id")], size="n").collect() == [] and M.auroc(none, ["g"]).collect() == []
