"""Models fitted by sums over rows: against numpy on all rows at once, over blocks in tasks and on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gradients as G
from tessera.operators import learning as L


@pytest.fixture(params=["driver", "tasks"])
def where(request, monkeypatch):
    if request.param == "tasks":
        monkeypatch.setattr(G, "HERE", 0)
        monkeypatch.setattr(G, "TASK", 4000)
        monkeypatch.setattr(G, "BLOCK", 37)
    return request.param


def data(n=300, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(2500, 900, n), rng.exponential(3, n)
    y = (a / 900 + b + rng.normal(0, 1.5, n) > 6).astype(int)
    missing = rng.random(n) < 0.1
    return [(i, int(y[i]), i % 5, float(a[i]), None if missing[i] else float(b[i]), 7.0) for i in range(n)]


def reference(rows, columns, fold, epochs, rate, penalty):
    """Scores of a fold's rows by full gradient steps on the others."""
    whole = [r for r in rows if all(r[3 + c] is not None for c in columns)]
    x, y, f = np.array([[r[3 + c] for c in columns] for r in whole]), np.array([r[1] for r in whole], float), np.array([r[2] for r in whole])
    train, test = f != fold, f == fold
    mean, std = x[train].mean(0), x[train].std(0)
    std[std < 1e-8] = 1
    z = (x - mean) / std
    w, b = np.zeros(len(columns)), 0.0
    for _ in range(epochs):
        gap = 1 / (1 + np.exp(-np.clip(z[train] @ w + b, -40, 40))) - y[train]
        w, b = w - rate * (z[train].T @ gap / train.sum() + penalty * w), b - rate * gap.mean()
    return {whole[i][0]: 1 / (1 + np.exp(-(z[i] @ w + b))) for i in np.flatnonzero(test)}


def test_out_of_fold_scores_equal_numpy(spark, where):
    rows, epochs = data(), 2000 if where == "driver" else 60
    frame = spark.createDataFrame([*rows, (900, None, 1, 1.0, 1.0, 7.0)], "k long, y int, f int, a double, b double, c double").repartition(4)
    sets = {"a": ["a"], "ba": ["b", "a"], "all": ["a", "b", "c"]}
    got = {(r.features, r.k): r.score for r in L.out_of_fold_scores(frame, sets, "y", "f", "k", 5, epochs=epochs).collect()}
    want = {}
    for name, columns in (("a", [0]), ("ba", [1, 0]), ("all", [0, 1, 2])):
        for fold in range(5):
            want |= {(name, k): s for k, s in reference(rows, columns, fold, epochs, 0.1, 1e-3).items()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_one_fold_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 1, 0, 2.0), (2, 0, 0, 3.0)], "k long, y int, f int, a double")
    assert {r.score for r in L.out_of_fold_scores(frame, {"a": ["a"]}, "y", "f", "k", 2, epochs=5).collect()} == {0.5}
    assert L.out_of_fold_scores(frame.limit(0), {"a": ["a"]}, "y", "f", "k", 2, epochs=5).collect() == []


def adamw(x, y, number, val, classes, epochs, rate, decay, batch, seed):
    """One group's model by the rules, all rows at once."""
    mean, std = x.mean(0), np.maximum(x.std(0, ddof=1), 1e-6)
    z, zv = (x - mean) / std, (val[0] - mean) / std
    rng, edge = np.random.default_rng(seed), 1 / np.sqrt(x.shape[1])
    p = [rng.uniform(-edge, edge, (1, classes, x.shape[1]))[0], rng.uniform(-edge, edge, (1, classes))[0]]
    m, v, t, best, right, at = [0, 0], [0, 0], 0, None, -1, 0
    batches = max(1, -(-len(x) // batch))
    for epoch in range(1, epochs + 1):
        of = G.batch_of(number, seed, epoch, batches)
        for s in range(batches):
            i = of == s
            if not i.any():
                continue
            e = np.exp(z[i] @ p[0].T + p[1])
            gap = (e / e.sum(1, keepdims=True) - np.eye(classes)[y[i]]) / i.sum()
            t += 1
            for k, g in enumerate((gap.T @ z[i], gap.sum(0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        acc = ((zv @ p[0].T + p[1]).argmax(1) == val[1]).mean()
        if acc > right:
            right, best, at = acc, [q.copy() for q in p], epoch
    return best, mean, std, at


def test_probe_equals_numpy(spark, where):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 4, 400)
    x = rng.normal(0, 1, (400, 6)) + np.eye(4, 6)[y] * 1.5
    split = np.array(["train", "val", "test"])[rng.choice(3, 400, p=[0.7, 0.15, 0.15])]
    frame = spark.createDataFrame([(i, "g", str(split[i]), x[i].tolist(), int(y[i])) for i in range(400)], "k long, variant string, split string, v array<double>, label int").repartition(3)
    both = frame.unionByName(frame.where("k % 2 = 0").withColumn("variant", F.lit("half")))
    scored, report = L.trained_probe(both, "variant", "split", "v", "label", "k", 4, epochs=6, rate=0.05, batch=64)
    train, val = split == "train", split == "val"
    best, mean, std, at = adamw(x[train], y[train], np.arange(400)[train], (x[val], y[val]), 4, 6, 0.05, 1e-2, 64, 17)
    z = (x - mean) / std @ best[0].T + best[1]
    share = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    got = {r.k: r for r in scored.where("variant = 'g'").collect()}
    assert len(got) == 400
    for i in range(400):
        order = np.argsort(-share[i], kind="stable")
        assert got[i].predicted == order[0] and got[i].gold_rank == list(order).index(y[i]) + 1 and got[i].gold_share == pytest.approx(share[i, y[i]], abs=1e-9)
        assert [t.label for t in got[i].top5] == list(order[:5]) and got[i].split == split[i]
    told = {(r.variant, r.split): r for r in report.collect()}
    test = told["g", "test"]
    assert (test.n, test.best_epoch, test.chance) == ((split == "test").sum(), at, 0.25) and len(told) == 6
    mine = split == "test"
    assert test.accuracy == pytest.approx((z[mine].argmax(1) == y[mine]).mean()) and test.loss == pytest.approx(-np.log(share[mine, y[mine]]).mean(), abs=1e-9)


def probed(spark, batch):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 400)
    x = rng.normal(0, 1, (400, 5)) + np.eye(3, 5)[y]
    frame = spark.createDataFrame([(i % 2, int(y[i]), x[i].tolist(), int(i % 5 == 0), i) for i in range(400)], "group int, label int, x array<double>, part int, number long").repartition(3)
    context = spark.sparkContext
    context.setJobGroup(f"probe{batch}", "probe")
    try:
        return G.fit_softmax(frame, 5, 3, 2, epochs=3, rate=0.05, batch=batch), len(context.statusTracker().getJobIdsForGroup(f"probe{batch}"))
    finally:
        context.setJobGroup("", "")


def test_an_epoch_takes_as_many_jobs_for_any_number_of_steps(spark, monkeypatch):
    for name, value in (("HERE", 0), ("TASK", 4000), ("BLOCK", 37)):
        monkeypatch.setattr(G, name, value)
    (_, few), (_, many) = probed(spark, 80), probed(spark, 4)
    assert many == few


def test_runs_and_passes_give_the_same_model(spark, monkeypatch):
    here, _ = probed(spark, 32)
    for name, value in (("HERE", 0), ("TASK", 4000), ("BLOCK", 37), ("RUN", 0)):
        monkeypatch.setattr(G, name, value)
    passes, _ = probed(spark, 33)
    monkeypatch.setattr(G, "RUN", 8 * 5 * 34)  # one step a run
    runs, _ = probed(spark, 33)
    for name in here:
        assert np.allclose(passes[name], runs[name], atol=1e-12) and here[name].shape == runs[name].shape
