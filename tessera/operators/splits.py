"""Splits of cases by a seeded hash: the same rows fall on the same side wherever they lie, and nothing is shuffled at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import placed


def seeded(seed: str, *keys: str) -> Column:
    """A place for each key: md5 of seed and key, which other engines give too."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def cut_sizes(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Sizes of train and val, rounded half to even; each at least one, and one left over, where n is three or more."""
    t = F.greatest(F.lit(1), F.bround(n * train).cast("long"))
    v = F.greatest(F.lit(1), F.bround(n * val).cast("long"))
    fits = t + v < n
    return F.when(fits, t).otherwise(F.greatest(n - 2, F.lit(1))), F.when(fits, v).otherwise(F.lit(1))


def stratified(frame: DataFrame, group: str, case: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """case, group, split: each group's cases in order of hash, the first train, the next val, the rest test; a case is never divided."""
    cases = frame.groupBy(case).agg(F.min(group).alias(group))
    return cut(cases, group, case, seed, train, val)


def cut(cases: DataFrame, group: str, case: str, seed: str, train: float, val: float) -> DataFrame:
    ranked = placed(cases, [group], [seeded(seed, case), F.asc(case)], place="_i", size="_n")
    t, v = cut_sizes(F.col("_n"), train, val)
    split = F.when(F.col("_i") <= t, "train").when(F.col("_i") <= t + v, "val").otherwise("test")
    return ranked.select(case, group, split.alias("split"))


def held_out_groups(frame: DataFrame, group: str, case: str, seed: str, n_held: int | None = None, train: float = 0.8, val: float = 0.1, named: list[str] | None = None, share: float | None = None) -> DataFrame:
    """case, group, split: all cases of some groups are heldout, those of the others are cut.

    Held out are the groups ``named``, else the first ``n_held`` by hash, else the first ``share`` of all, rounded half to even. An unknown name
    and a number that leaves no group on either side are errors. Groups are counted first, by a job that sends a row for each.
    """
    groups = frame.select(group).where(F.col(group).isNotNull()).distinct()
    if named is not None:
        held = groups.where(F.col(group).isin(named))
        if held.count() < len(set(named)):
            known = {r[0] for r in held.collect()}  # at most the names given
            raise ValueError(f"unknown groups: {sorted(set(named) - known)}")
        n_held = len(set(named))
    total = groups.count()
    n = n_held if n_held is not None else round(total * (share or 0))
    if not 0 < n < total:
        raise ValueError(f"{n} groups to hold out of {total}")
    if named is None:
        held = groups.orderBy(seeded(seed, group), group).limit(n)
    cases = stratified(frame, group, case, seed, train, val)
    return cases.join(held.withColumn("_held", F.lit(True)), group, "left").select(case, group, F.when(F.col("_held"), "heldout").otherwise(F.col("split")).alias("split"))


def aligned(frame: DataFrame, group: str, case: str, good: Column, least: int, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Train and val only from good cases of groups that have ``least`` of them; the groups' other cases are test, other groups are left out."""
    fit = frame.groupBy(group).agg(F.count_if(good).alias("_n")).where(F.col("_n") >= least).select(group)
    rows = frame.join(fit, group, "left_semi")
    chosen = cut(rows.where(good).select(case, group), group, case, seed, train, val).select(case, "split")
    return rows.select(case, group).join(chosen, case, "left").select(case, group, F.coalesce("split", F.lit("test")).alias("split"))


def held_out_values(frame: DataFrame, case: str, value: str, seed: str, share: int, test_share: int) -> DataFrame:
    """``frame`` with split: values of hash below share/16 are held out, cases below test_share/16 are test; held-out values in other cases are dropped."""
    digit = lambda *k: F.conv(F.substring(seeded(seed, *k), 1, 1), 16, 10).cast("int")
    held, test = digit(value) < share, digit(case) < test_share
    return frame.withColumn("split", F.when(held & test, "test_unseen").when(test, "test_seen").when(held, "dropped").otherwise("train"))


def unseen(train: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """``test`` with seen: whether ``train`` has its value."""
    known = train.select(value).distinct().withColumn("seen", F.lit(True))
    return test.join(known, value, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def folds(frame: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """``frame`` with fold: dealt in turn within each group, in order of hash."""
    ranked = placed(frame, [group], [seeded(seed, key), F.asc(key)], place="_i")
    return ranked.withColumn("fold", F.pmod(F.col("_i") - 1, F.lit(k)).cast("int")).drop("_i")


def leaks(split: DataFrame, case: str) -> DataFrame:
    """Cases that lie in more than one split."""
    return split.groupBy(case).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")
