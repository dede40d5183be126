"""Signals that a source's answer is wrong: how well each ranks errors, what disagreement alone would flag, and both kinds of disagreement on the rows that have both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.metrics import auroc, average_precision, confusion

#: A signal, its column, and whether a greater value speaks for an error; disagreement is the opposite of its column.
SIGNALS = (
    ("source_readout_disagree", "source_readout_answer_agree", -1), ("source_probe_disagree", "source_probe_answer_agree", -1), ("probe_low_top1_prob", "probe_top1_prob", -1), ("source_low_top1_prob", "source_top1_prob", -1),
    ("source_low_top1_top2_prob_margin", "source_top1_top2_prob_margin", -1), ("source_low_top1_top2_margin", "source_top1_top2_margin", -1), ("source_entropy", "source_candidate_entropy_norm", 1),
)
DISAGREEMENT = ("source_readout_disagree", "source_probe_disagree")


def _score(signal: str, field: str, direction: int) -> Column:
    if signal in DISAGREEMENT:
        return F.when(F.col(field).isNotNull(), F.when(F.col(field).cast("boolean"), 0.0).otherwise(1.0))
    return F.col(field).cast("double") * direction


def signal_rows(rows: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, label, signal and score of each row and signal whose column the table has; missing labels and values are left out."""
    each = [F.struct(F.lit(s).alias("signal"), _score(s, f, d).alias("score")) for s, f, d in SIGNALS if f in rows.columns]
    return rows.where(F.col(label).isNotNull()).select(key, F.col(label).cast("boolean").alias("label"), F.explode(F.array(*each)).alias("s")).select(key, "label", "s.*").where("score IS NOT NULL")


def signal_report(rows: DataFrame, key: str, label: str) -> DataFrame:
    """signal, n, auroc, average_precision (ties in order of ``key``), and for disagreement the counts and rates of flagging it; null for other signals."""
    known = signal_rows(rows, key, label)
    flagged = confusion(known.where(F.col("signal").isin(*DISAGREEMENT)), ["signal"], F.col("label"), F.col("score") >= 0.5)
    return auroc(known, ["signal"]).drop("positives").join(average_precision(known, ["signal"], key), "signal").join(flagged, "signal", "left")


def paired_disagreement(rows: DataFrame, key: str, label: str) -> DataFrame:
    """n, readout_auroc, probe_auroc and their difference on the rows that have a label and both agreements; no row if there are none."""
    both = rows.where(F.col("source_readout_answer_agree").isNotNull() & F.col("source_probe_answer_agree").isNotNull())
    found = auroc(signal_rows(both, key, label).where(F.col("signal").isin(*DISAGREEMENT)), ["signal"])
    of = lambda s: F.max(F.when(F.col("signal") == s, F.col("auroc")))
    one = found.groupBy().agg(F.max("n").alias("n"), of(DISAGREEMENT[0]).alias("readout_auroc"), of(DISAGREEMENT[1]).alias("probe_auroc")).where("n IS NOT NULL")
    return one.withColumn("difference", F.col("readout_auroc") - F.col("probe_auroc"))


def error_rate(rows: DataFrame, label: str) -> DataFrame:
    """n, errors and error_rate of the rows with a label; an error if there are none."""
    sums = rows.agg(F.count(label).alias("n"), F.count_if(F.col(label).cast("boolean")).alias("errors"))
    rate = F.when(F.col("n") == 0, F.raise_error(F.lit("no row has a label")).cast("double")).otherwise(F.col("errors").cast("double") / F.col("n"))
    return sums.withColumn("error_rate", rate)
