"""Gates: rows that break a rule. An empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rows import first_k


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each rule a row breaks; null counts as kept."""
    broken = F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in sorted(rules.items())]), lambda r: r.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def gate(found: DataFrame, most: int = 40) -> DataFrame:
    """rule, n_violations and the first keys: what a report of a failed gate shows."""
    key = found.columns[0]
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_violations"))
    shown = first_k(found, "rule", [key], most).groupBy("rule").agg(F.array_sort(F.collect_list(key)).alias("first_keys"))
    return counts.join(shown, "rule")


def must_pass(found: DataFrame) -> None:
    """Raise if a row is there."""
    if not found.isEmpty():
        raise ValueError(f"violations: {[tuple(r) for r in gate(found).collect()]}")


def cue_rules(cues: str, prompt: str) -> dict[str, Column]:
    """No cues, cues that aren't in the prompt, cues twice (case aside), a cue within another."""
    c = F.col(cues)
    lower = F.transform(c, lambda x: F.lower(x))
    return {
        "no_cues": F.size(c) == 0,
        "not_verbatim": F.exists(c, lambda x: ~F.contains(F.col(prompt), x)),
        "duplicate": F.size(F.array_distinct(lower)) < F.size(c),
        "nested": F.exists(lower, lambda x: F.exists(lower, lambda y: (x != y) & F.contains(y, x))),
    }


def value_diversity(rows: DataFrame, value: str, near: float = 0.5) -> DataFrame:
    """n, distinct_values, once_share, top_share and near_constant (values that at least ``near`` of the rows have)."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("c") == 1).alias("once"), F.max("c").alias("top"))
    many = counts.crossJoin(F.broadcast(sums.select("n"))).where(F.col("c") >= near * F.col("n")).agg(F.count(F.lit(1)).alias("near_constant"))  # one row
    return sums.crossJoin(many).select("n", "distinct_values", F.try_divide(F.col("once").cast("double"), F.col("distinct_values")).alias("once_share"), F.try_divide(F.col("top").cast("double"), F.col("n")).alias("top_share"), "near_constant")


def presence(frame: DataFrame) -> DataFrame:
    """field, present: rows that have a value, of each column, in one pass."""
    counts = frame.agg(*[F.count(c).alias(c) for c in frame.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in frame.columns])).alias("f")).select("f.*")
