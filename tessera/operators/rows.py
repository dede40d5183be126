"""Row operators: lookups, quotas, dedupes, pairings, donors, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import placed
from tessera.sources.scratch import written


def last_by(frame: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order; summed up before the shuffle."""
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def first_by(frame: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def look_up_all(base: DataFrame, sides: list[tuple[DataFrame, str]], key: str, order: str) -> DataFrame:
    """``base`` left joined with each side on ``key``; of a side's equal keys the last in order counts, its columns get its prefix."""
    for side, prefix in sides:
        one = last_by(side, key, order)
        base = base.join(one.select(key, *[F.col(c).alias(prefix + c) for c in one.columns if c not in (key, order)]), key, "left")
    return base


def matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a partner, and those of ``left`` without; an error at run time if ``right`` repeats a key."""
    n = Window.partitionBy(key)
    single = right.withColumn("_n", F.count(F.lit(1)).over(n)).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("repeated key")))).drop("_n")
    return left.join(single, key), left.join(right, key, "left_anti")


def first_k(frame: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group. Spark drops the others in each task before the shuffle."""
    return frame.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_i") <= k).drop("_i")


def quota(frame: DataFrame, group: str, order: list[str], k: int, most_groups: int | None = None) -> DataFrame:
    """First k rows of each group that has k; of the groups the ones with the smallest names."""
    full = frame.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(group)
    if most_groups is not None:
        full = full.orderBy(group).limit(most_groups)
    return first_k(frame, group, order, k).join(full, group, "left_semi")


def eligible(frame: DataFrame, group: str, good: Column, least: int) -> DataFrame:
    """Groups with ``least`` good rows or more: group, n, n_good."""
    return frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good")).where(F.col("n_good") >= least)


def with_mismatched_donor(frame: DataFrame, key: str, group: str, seed: str) -> DataFrame:
    """``frame`` with donor, the key of a row of another group, chosen by hash; null if there is one group only.

    Rows are numbered group after group, so the rows of other groups are two ranges of numbers; the hash picks a number
    there and one equi-join finds its row. Each group's first number and size come from sums over the group, by task first.
    """
    numbered = placed(frame, [], [F.asc(group), F.asc(key)], place="_number", size="_all").withColumn("_number", F.col("_number") - 1)
    spans = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("_number").alias("_from"), F.count(F.lit(1)).alias("_size"))
    numbered = numbered.join(written(spans), F.col(group).eqNullSafe(F.col("_g")))
    others = F.col("_all") - F.col("_size")
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    step = F.when(others > 0, F.pmod(h, others))
    asked = numbered.withColumn("_asked", F.when(step < F.col("_from"), step).otherwise(step + F.col("_size")))
    donors = numbered.select(F.col("_number").alias("_asked"), F.col(key).alias("donor"), F.col(group).alias(f"donor_{group}"))
    return asked.join(donors, "_asked", "left").select(*frame.columns, "donor", f"donor_{group}")


def compared_variants(frame: DataFrame, base: str, variant: str, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """For each (name, left, right) the base's rows of both variants side by side; bases that lack one are left out."""
    spec = frame.sparkSession.createDataFrame(pairs, "comparison string, left_key string, right_key string")
    rest = [c for c in frame.columns if c not in (base, variant)]
    left = frame.select(base, F.col(variant).alias("left_key"), F.struct(*rest).alias("left"))
    right = frame.select(base, F.col(variant).alias("right_key"), F.struct(*rest).alias("right"))
    return left.join(F.broadcast(spec), "left_key").join(right, [base, "right_key"])  # the list is a parameter


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shard(frame: DataFrame, order: str, shards: int, index: int) -> DataFrame:
    """Rows whose place in order, modulo ``shards``, is ``index``. """
    return placed(frame, [], [F.asc(order)], place="_place").where(F.pmod(F.col("_place") - 1, F.lit(shards)) == index).select(frame.columns)
