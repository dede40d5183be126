"""Metrics of scored and labelled rows, as plans that sum up before they order.

Each takes rows (by columns, label boolean, score double) and gives a row a group. Ranks are found on the different scores of a
group, by ranges of them, so that neither many rows nor many different scores of a group meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import ratio
from tessera.operators.ranking import placed


def auroc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """``by``, n, positives, auroc: the chance that a positive has the greater score, ties counting half; null if one class is missing. Null labels and scores don't count."""
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    steps = known.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = placed(steps, by, [F.asc(score)], before={"lower": F.col("n") - F.col("pos")})
    # twice the wins: whole numbers, so the order of adding doesn't matter
    wins = F.col("pos") * (2 * F.col("lower") + F.col("n") - F.col("pos"))
    sums = steps.groupBy(*by).agg(F.sum(wins).alias("wins"), F.sum("pos").alias("positives"), F.sum("n").alias("n"))
    pairs = 2 * F.col("positives") * (F.col("n") - F.col("positives"))
    return sums.select(*by, "n", "positives", ratio(F.col("wins"), pairs, None).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str], order: str, label: str = "label", score: str = "score") -> DataFrame:
    """``by``, average_precision: mean precision at the positives in order of falling score, ties in order of ``order``; null without positives."""
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    ranked = placed(known, by, [F.desc(score), F.asc(order)], place="_rank", before={"_hits": F.col(label).cast("long")})
    return ranked.groupBy(*by).agg(F.avg(F.when(F.col(label), (F.col("_hits") + 1).cast("double") / F.col("_rank"))).alias("average_precision"))


def confusion(rows: DataFrame, by: list[str], label: Column, predicted: Column) -> DataFrame:
    """``by``, the four counts, and precision, recall, specificity and accuracy with zero for empty ratios."""
    cell = lambda ok: F.count_if(ok).alias("x")
    counts = rows.groupBy(*by).agg(
        cell(predicted & label).alias("tp"), cell(predicted & ~label).alias("fp"), cell(~predicted & ~label).alias("tn"), cell(~predicted & label).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, tp + fp + tn + fn)}
    )


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place int(share * n) (from 0, at most the last) of a sorted array."""
    n = F.size(values)
    return F.get(values, F.least(n - 1, F.floor(n * share).cast("int")))


def profile(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by``, n, least, greatest, mean and one column a share, by nearest rank. Places are found on the different values with their counts."""
    steps = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    steps = placed(steps, by, [F.asc("v")], before={"lower": F.col("c")}, sums={"n": F.col("c")}).withColumn("upto", F.col("lower") + F.col("c"))
    at = lambda share: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share)))
    cuts = [F.min(F.when(F.col("upto") > at(share), F.col("v"))).alias(name) for name, share in shares.items()]
    return steps.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), (F.sum(F.col("v") * F.col("c")).cast("double") / F.sum("c")).alias("mean"), *cuts)


def answer_spread(samples: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """``key``, n_samples, unique_answers, top_answer (of equal counts the first met), top_share, entropy (by log of n; 0 for one sample)."""
    counts = samples.groupBy(key, answer).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("first"))
    totals = counts.withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    p = F.col("c").cast("double") / F.col("n")
    return totals.groupBy(key).agg(
        F.first("n").alias("n_samples"),
        F.count(answer).alias("unique_answers"),
        F.max_by(answer, F.struct(F.col("c"), -F.col("first"))).alias("top_answer"),
        (F.max("c").cast("double") / F.first("n")).alias("top_share"),
        F.when(F.first("n") > 1, -F.sum(p * F.ln(F.greatest(p, F.lit(1e-30)))) / F.ln(F.first("n").cast("double"))).otherwise(0.0).alias("entropy"),
    )
