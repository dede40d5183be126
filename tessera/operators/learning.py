"""Models: cross-validated logistic regression and linear softmax probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.gradients import Softmax, fit_logistic, fit_softmax


def out_of_fold_scores(rows: DataFrame, sets: dict[str, list[str]], label: str, fold: str, key: str, n_folds: int, epochs: int = 2000, rate: float = 0.1, penalty: float = 1e-3) -> DataFrame:
    """features, key, label, fold, score: for each named set of features each fold's rows, scored by a logistic model of the others; rows that lack a label or a feature of the set are left out. All models are fitted in the same passes."""
    names = list(dict.fromkeys(c for features in sets.values() for c in features))
    known = rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in names]).alias("x")
    )
    weights, bias, mean, spread = fit_logistic(known, len(names), [[names.index(c) for c in features] for features in sets.values()], n_folds, epochs, rate, penalty)
    models = [
        (s, f, [int(i) for i in (names.index(c) for c in sets[s])], (weights / spread)[m].tolist(), float(bias[m]), mean[m].tolist())
        for m, (s, f) in enumerate((s, f) for s in sets for f in range(n_folds))
    ]
    shown = rows.sparkSession.createDataFrame(models, "features string, fold int, used array<int>, slope array<double>, bias double, mean array<double>")
    each = known.join(F.broadcast(shown), "fold")  # a row for each set and fold
    z = F.aggregate("used", F.col("bias"), lambda a, i: a + (F.get("x", i) - F.get("mean", i)) * F.get("slope", i))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    return each.where(F.forall("used", lambda i: F.get("x", i).isNotNull())).select("features", F.col("k").alias(key), F.col("y").alias(label), F.col("fold").alias(fold), score.alias("score"))


def trained_probe(rows: DataFrame, group: str, split: str, vector: str, label: str, key: str, classes: int, epochs: int = 80, rate: float = 1e-3, decay: float = 1e-2, batch: int = 512, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Scored rows (group, split, key, label, predicted, gold_rank, gold_share, top5 with their shares) and a report (group, split, n, loss, accuracy, accuracy_at_5, chance, best_epoch) of a linear softmax probe for each group.

    Splits are train, val and test; ``key`` is a long; ranks are in order of share, ties by class.
    """
    names = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]  # a model for each: as many as the caller asks for
    size = rows.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 1
    part = F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).otherwise(2)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(group)) - 1 if names else F.lit(0)
    known = rows.select(number.cast("int").alias("group"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("x"), part.alias("part"), F.col(key).cast("long").alias("number"))
    model = fit_softmax(known.where("part < 2"), size, classes, len(names), epochs, rate, decay, batch, seed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, label, split, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            shares = np.zeros((len(group), classes))
            for g in np.unique(group):
                i = np.flatnonzero(group == g)
                shares[i] = Softmax.shares(Softmax.logits((x[i] - model["mean"][g]) / model["spread"][g], model["weights"][g], model["bias"][g]))
            order = np.argsort(-shares, axis=1, kind="stable")
            rank = (order == label[:, None]).argmax(1) + 1
            top = order[:, :5]
            five = [[{"label": int(c), "share": float(s)} for c, s in zip(a, b, strict=True)] for a, b in zip(top, np.take_along_axis(shares, top, 1), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(split), pa.array(number), pa.array(label), pa.array(order[:, 0].astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(shares[np.arange(len(label)), label]), pa.array(five, pa.list_(pa.struct([("label", pa.int32()), ("share", pa.float64())])))],
                names=["group", "part", "number", "label", "predicted", "gold_rank", "gold_share", "top5"],
            )

    scored = known.mapInArrow(score, "group int, part int, number long, label int, predicted int, gold_rank int, gold_share double, top5 array<struct<label:int,share:double>>")
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("group")) if names else F.lit(None)
    side = F.get(F.array(*[F.lit(s) for s in ("train", "val", "test")]), F.col("part"))
    found = scored.select(name.alias(group), side.alias(split), F.col("number").alias(key), F.col("label").alias(label), "predicted", "gold_rank", "gold_share", "top5")
    epoch = F.get(F.array(*[F.lit(int(e)) for e in model["epoch"]]), F.array_position(F.array(*[F.lit(n) for n in names]), F.col(group)).cast("int") - 1) if names else F.lit(0)
    at = lambda ok: F.avg(ok.cast("double"))
    report = found.groupBy(group, split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(-F.ln(F.greatest("gold_share", F.lit(1e-300)))).alias("loss"), at(F.col("gold_rank") == 1).alias("accuracy"), at(F.col("gold_rank") <= 5).alias("accuracy_at_5")
    )
    return found, report.withColumn("chance", F.lit(1 / classes)).withColumn("best_epoch", epoch)


def native_probe(train: DataFrame, test: DataFrame, vector: str, label: str, key: str, iterations: int = 30, penalty: float = 1e-3) -> DataFrame:
    """key, label, predicted, gold_rank, gold_share and top5 of ``test`` by a multinomial regression on ``train``; equal shares rank by class."""
    as_rows = lambda f: f.select(F.col(key), F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = LogisticRegression(family="multinomial", maxIter=iterations, regParam=penalty).fit(as_rows(train))
    shares = model.transform(as_rows(test)).select(key, F.col("label").cast("int").alias(label), vector_to_array("probability").alias("p"))
    order = F.transform(F.array_sort(F.transform("p", lambda s, i: F.struct((-s).alias("s"), i.alias("c")))), lambda x: x["c"])
    ranked = shares.withColumn("_order", order)
    return ranked.select(key, label, F.get("_order", F.lit(0)).alias("predicted"), F.array_position("_order", F.col(label)).alias("gold_rank"), F.get("p", F.col(label)).alias("gold_share"), F.slice("_order", 1, 5).alias("top5"))


def probe_metrics(scored: DataFrame) -> DataFrame:
    """n, accuracy, accuracy_at_5, cross_entropy, mean_rank of native_probe's rows."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("gold_rank") == 1).cast("double")).alias("accuracy"),
        F.avg((F.col("gold_rank") <= 5).cast("double")).alias("accuracy_at_5"),
        F.avg(-F.ln(F.greatest("gold_share", F.lit(1e-30)))).alias("cross_entropy"),
        F.avg("gold_rank").alias("mean_rank"),
    )


def candidate_features(scores: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """By key of scored candidates: top1, top2, their margin, shares by softmax, entropy and entropy by log of their number. One candidate has no second: null."""
    order = Window.partitionBy(key).orderBy(F.desc(score), candidate)
    top = Window.partitionBy(key)
    ranked = scores.withColumn("_i", F.row_number().over(order)).withColumn("_p", F.exp(F.col(score) - F.max(score).over(top)))
    shared = ranked.withColumn("_p", F.col("_p") / F.sum("_p").over(top))
    nth = lambda n, c: F.max(F.when(F.col("_i") == n, F.col(c)))
    h = -F.sum(F.col("_p") * F.ln(F.greatest("_p", F.lit(1e-30))))
    return shared.groupBy(key).agg(
        nth(1, candidate).alias("top1"),
        nth(1, score).alias("top1_score"),
        (nth(1, score) - nth(2, score)).alias("margin"),
        nth(1, "_p").alias("top1_share"),
        (nth(1, "_p") - nth(2, "_p")).alias("share_margin"),
        h.alias("entropy"),
        F.when(F.count(F.lit(1)) > 1, h / F.ln(F.count(F.lit(1)).cast("double"))).otherwise(0.0).alias("entropy_share"),
    )


def ranked_candidates(scores: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """``scores`` with rank: 1 for the best of its key, ties by candidate."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), candidate)))
