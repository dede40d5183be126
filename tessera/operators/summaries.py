"""Summaries of readouts, samples, controls and candidates; lookups with fallbacks; filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.metrics import answer_spread, auroc, average_precision
from tessera.functions.text import answer_key, candidate_key
from tessera.functions.values import ratio
from tessera.operators.ranking import placed
from tessera.operators.splits import seeded

# filters ----------------------------------------------------------------------------------------------------------------


def present(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows that have all of ``names``: neither null nor empty."""
    for n in names:
        frame = frame.where(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    return frame


def has_count(count: Column, variant: Column, wanted: str) -> Column:
    """The cue count is ``wanted``, or the variant's name says so."""
    return F.coalesce(count.cast("string") == wanted, F.lit(False)) | F.coalesce((variant == f"cue_count_{wanted}") | F.endswith(variant, F.lit(f"_cues_{wanted}")), F.lit(False))


def in_group(variant: Column, group: str) -> Column:
    """A group is a variant, but for a name ending in _all, which takes all that start alike."""
    return F.startswith(variant, F.lit(group.removesuffix("all"))) if group.endswith("_all") else variant == group


def too_long(norm: Column, most: float) -> Column:
    """Whether a norm is over ``most``; no number isn't."""
    return F.coalesce(norm.cast("string").try_cast("double") > most, F.lit(False))


# names ------------------------------------------------------------------------------------------------------------------


def variant_of(key: Column, variant: Column) -> Column:
    """The variant, else what follows the first two underscores of the key."""
    at = F.call_function("locate", F.lit("__"), key)
    return F.coalesce(variant, F.when(at > 0, F.substring(key, at + 2, F.length(key))))


def domain_of(path: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """The first domain one of whose words a path holds, case aside; an error if there is none."""
    out = F.raise_error(F.concat(F.lit("no domain: "), path)).cast("string")
    for name, words in reversed(list(domains.items())):
        out = F.when(F.lower(path).rlike("|".join(words)), name).otherwise(out)
    return out


def recovered_cues(lists: list[Column], text: Column, tagged: Column) -> Column:
    """The first of ``lists`` that isn't empty, else the text alone, else the tagged text without its tags."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(tagged, "<[^>]+>", " "), r"\s+", " "))
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.when(text != "", F.array(text)), F.array(bare))


def candidates(rows: DataFrame, key: str, name: str, alias: str, order: str) -> DataFrame:
    """``key`` and name, the first one met, of blank ones the first alias."""
    said = F.when(F.btrim(F.col(name)) != "", F.col(name))
    return rows.groupBy(key).agg(F.coalesce(F.min_by(said, F.when(said.isNotNull(), F.col(order))), F.min_by(alias, order)).alias("name"))


def with_candidate_ids(rows: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """``rows`` with id of the candidate (``known``: id, name) whose name has the same key, else one made of the name."""
    side = known.groupBy(answer_key(F.col("name")).alias("_k")).agg(F.min("id").alias("id"))
    return rows.withColumn("_k", answer_key(F.col(name))).join(side, "_k", "left").withColumn("id", F.coalesce("id", candidate_key(F.col(name)))).drop("_k")


def labelled(rows: DataFrame, item: str, value: str, meanings: DataFrame, labels: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` with label: of ``meanings`` (item, value, label), else of the item (``labels``), else of ``others`` like the first, else the value itself."""
    first = meanings.select(F.col("item").alias(item), F.col("value").alias(value), F.col("label").alias("_a"))
    second = labels.select(F.col("item").alias(item), F.col("label").alias("_b"))
    third = others.select(F.col("item").alias(item), F.col("value").alias(value), F.col("label").alias("_c"))
    joined = rows.join(first, [item, value], "left").join(second, item, "left").join(third, [item, value], "left")
    return joined.withColumn("label", F.when(F.col(value).isNotNull(), F.coalesce("_a", "_b", "_c", F.col(value).cast("string")))).drop("_a", "_b", "_c")


# rows of groups ---------------------------------------------------------------------------------------------------------


def capped(frame: DataFrame, group: str, key: str, seed: str, k: int) -> DataFrame:
    """At most ``k`` rows a group, the first by hash; the limit is pushed before the shuffle."""
    return frame.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, key), key))).where(F.col("_i") <= k).drop("_i")


def ordered_samples(samples: DataFrame, key: str, order: str, answer: str) -> DataFrame:
    """``key`` and answers, in order of their sample number."""
    return samples.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, answer))), lambda s: s[answer]).alias("answers"))


def sample_summary(samples: DataFrame, key: str, answer: str, order: str, parsed: Column, hit: Column, recall: Column) -> DataFrame:
    """How much a case's samples differ (as answer_spread), the share of different answers, and the rates of parsed and of right samples and the mean recall, null where none is known."""
    rate = lambda ok: F.avg(F.coalesce(ok, F.lit(False)).cast("double"))
    rates = samples.groupBy(key).agg(rate(parsed).alias("parsed_rate"), rate(hit).alias("hit_rate"), F.avg(recall).alias("mean_recall"))
    spread = answer_spread(samples, key, answer, order).withColumn("unique_share", F.col("unique_answers").cast("double") / F.col("n_samples"))
    return spread.join(rates, key)


#: Signals of unstable answers, and whether a greater value speaks for an error.
STABILITY = {"entropy": ("entropy", 1), "low_top_share": ("top_share", -1), "unique_share": ("unique_share", 1), "low_parsed_rate": ("parsed_rate", -1), "low_mean_recall": ("mean_recall", -1)}


def stability(cases: DataFrame, key: str, label: str) -> DataFrame:
    """signal, n, auroc and average_precision of each signal of ``sample_summary`` rows against ``label``; a signal's missing values don't count, ties are in order of ``key``. Values count to nine places."""
    each = F.array(*[F.struct(F.lit(name).alias("signal"), (sign * F.round(column, 9)).alias("score")) for name, (column, sign) in STABILITY.items()])
    rows = cases.select(key, F.col(label).alias("label"), F.explode(each).alias("s")).select(key, "label", "s.*")
    return auroc(rows, ["signal"]).select("signal", "n", "auroc").join(average_precision(rows, ["signal"], key), "signal")


def group_folds(frame: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """``frame`` with fold: whole groups are dealt in turn, in order of hash."""
    groups = frame.select(group).distinct()
    dealt = placed(groups, [], [seeded(seed, group), F.asc(group)], place="_i").select(group, F.pmod(F.col("_i") - 1, F.lit(k)).cast("int").alias("fold"))
    return frame.join(dealt, group)


def held_out_bases(frame: DataFrame, base: str, seed: str, share: float) -> DataFrame:
    """``frame`` with split: the first ``share`` of its bases by hash (one at least) are val, with all their rows."""
    bases = frame.select(base).distinct()
    ranked = placed(bases, [], [seeded(seed, base), F.asc(base)], place="_i", size="_n")
    cut = F.when(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), "val").otherwise("train")
    return frame.join(ranked.select(base, cut.alias("split")), base)


# counts and rates -------------------------------------------------------------------------------------------------------


def reasons(cues: DataFrame, reason: str, polarity: str) -> DataFrame:
    """reason and n; what is kept counts by its polarity."""
    said = F.when(F.coalesce(F.col(reason), F.lit("")) != "", F.col(reason)).otherwise(F.concat(F.lit("KEPT("), F.col(polarity), F.lit(")")))
    return cues.groupBy(said.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def head_and_tail(rows: DataFrame, cue: str, recall: str, most: int = 12) -> DataFrame:
    """side, ``cue``, n, mean recall: the ``most`` cues of greatest and of least mean."""
    means = rows.groupBy(cue).agg(F.count(F.lit(1)).alias("n"), F.avg(recall).alias("mean"))
    side = lambda name, *order: means.orderBy(*order).limit(most).select(F.lit(name).alias("side"), cue, "n", "mean")
    return side("head", F.desc("mean"), cue).unionByName(side("tail", "mean", cue))


def by_role(rows: DataFrame, by: list[str], norm: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("mean_norm"))


def control_rates(rows: DataFrame, control: str, original_hit: str, donor_hit: str) -> DataFrame:
    """By control type: n, rate of hits of the original, of the donor among rows that have one, and counts of what was followed."""
    own, donor = F.col(original_hit), F.coalesce(F.col(donor_hit), F.lit(False))
    kind = {"both": own & donor, "donor_only": ~own & donor, "original_only": own & ~donor, "neither": ~own & ~donor}
    return rows.groupBy(control).agg(
        F.count(F.lit(1)).alias("n"), F.avg(own.cast("double")).alias("original_rate"), F.coalesce(F.avg(F.col(donor_hit).cast("double")), F.lit(0.0)).alias("donor_rate"), *[F.count_if(x).alias(n) for n, x in kind.items()]
    )


def rank_summary(rows: DataFrame, by: list[str], rank: str, parsed: Column, right: Column, near: int = 3) -> DataFrame:
    """n, mean rank and share within ``near`` of ranked rows only, shares of parsed and of right rows."""
    known = F.count(rank)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(rank).alias("mean_rank"), ratio(F.count_if(F.col(rank) <= near), known).alias("near_share"), ratio(F.count_if(parsed), F.count(F.lit(1))).alias("parse_rate"), ratio(F.count_if(right), F.count(F.lit(1))).alias("accuracy")
    )


def option_report(rows: DataFrame, by: list[str], top: str, said: str, gold: str, rank: str) -> DataFrame:
    """How often the top option is the one said or the gold one, and the mean rank; no rank counts as 0."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(top) == F.col(said)).alias("top_is_said"), F.count_if(F.col(top) == F.col(gold)).alias("top_is_gold"), F.count_if(F.col(said) == F.col(gold)).alias("said_is_gold"), F.avg(F.coalesce(F.col(rank), F.lit(0))).alias("mean_rank")
    )


def pool_delta(rows: DataFrame, pool: str, score: str, seen: str, unseen: str) -> DataFrame:
    """seen, unseen and delta of the mean score; an error if a pool is empty."""
    mean = lambda name: F.avg(F.when(F.col(pool) == name, F.col(score)))
    both = rows.agg(mean(seen).alias("seen"), mean(unseen).alias("unseen"))
    return both.select("seen", "unseen", F.coalesce(F.col("seen") - F.col("unseen"), F.raise_error(F.lit("a pool is empty")).cast("double")).alias("delta"))


def unique_ids(frame: DataFrame, key: str) -> DataFrame:
    """``frame``, or an error where a key occurs twice."""
    twice = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = twice.select(key, F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), F.col(key).cast("string"))).cast("boolean")).alias("_ok"))
    return frame.join(checked, key).where("_ok").drop("_ok")


def verdict(similarity: Column, strict: float, loose: float) -> Column:
    """copied, close or new, by two thresholds; null where nothing was compared."""
    return F.when(similarity >= strict, "copied").when(similarity >= loose, "close").when(similarity.isNotNull(), "new")
