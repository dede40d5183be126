"""Scoring of readouts, and summaries of what was scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.values import first_said, ratio


def scored_readouts(rows: DataFrame, output: str, aliases: str, cues: str) -> DataFrame:
    """``rows`` with the tags of a readout, alias and cue hits, recall and precision. An assessment stands in for a missing answer."""
    whole = X.unescape(F.coalesce(F.col(output), F.lit("")))
    rows = rows.withColumn("_out", whole).withColumn("readout", X.tag_body(F.col("_out"), "readout"))
    inner = F.coalesce("readout", "_out")
    tags = {t: X.tag_body(inner, t) for t in ("answer", "supporting_cues", "observed", "assessment")}
    rows = rows.withColumns(tags).withColumn("said", first_said(F.col("answer"), F.col("assessment")))
    shown = F.coalesce("supporting_cues", "observed", F.lit(""))
    hits = X.terms_in(shown, F.col(cues))
    items = X.list_items(shown)
    return rows.withColumns(
        {
            "answer_hit": F.size(X.terms_in(F.coalesce("said", F.lit("")), F.col(aliases))) > 0,
            "output_hit": F.size(X.terms_in(F.col("_out"), F.col(aliases))) > 0,
            "cue_recall": ratio(F.size(hits), F.size(F.col(cues)), None),
            "output_cue_recall": ratio(F.size(X.terms_in(F.col("_out"), F.col(cues))), F.size(F.col(cues)), None),
            "cue_precision": ratio(F.size(X.supported(items, F.col(cues))), F.size(items), None),
        }
    ).drop("_out")


def counterfactual_rates(rows: DataFrame, base: str, observed: str, threshold: float) -> DataFrame:
    """One row of rates over scored counterfactual rows (role, variant, slot, gold, original_cue, replacement_cue)."""
    reads = lambda cue: F.coalesce(X.tokens_said(F.col(cue), F.col("_said")), F.lit(0.0)) >= threshold
    marked = rows.withColumn("_said", X.content_tokens(F.col(observed))).withColumns({"_gold": reads("gold"), "_orig": reads("original_cue"), "_repl": reads("replacement_cue")})
    is_ = lambda role, variant: (F.col("role") == role) & (F.col("variant") == variant)
    share = lambda ok, among, name: ratio(F.count_if(ok & among), F.count_if(among)).alias(name)
    rates = marked.agg(
        share(F.col("_orig"), is_("swapped_slot", "orig"), "orig_reads_original"),
        share(F.col("_repl"), is_("swapped_slot", "swap"), "swap_reads_replacement"),
        share(F.col("_orig"), is_("swapped_slot", "swap"), "swap_still_reads_original"),
        *[share(F.col("_gold"), is_("retained", v), f"retained_{v}") for v in ("orig", "swap", "removed")],
        share(F.col("_orig"), is_("retained", "removed"), "phantom"),
    )
    pairs = marked.where("role = 'retained'").groupBy(base, "slot").pivot("variant", ["orig", "swap", "removed"]).agg(F.max("_gold")).where("orig IS NOT NULL")
    lost = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        ratio(F.count_if(F.col("orig") & ~F.col("swap")), F.count(F.lit(1))).alias("degraded_by_swap"),
        ratio(F.count_if(F.col("orig") & ~F.col("removed")), F.count(F.lit(1))).alias("degraded_by_removal"),
    )
    return rates.crossJoin(lost)  # one row and one row


def first_class(ordered: list[tuple[str, Column]], other: str) -> Column:
    """The name of the first condition that holds for any row of a group."""
    out = F.lit(other)
    for name, ok in reversed(ordered):
        out = F.when(F.bool_or(ok), name).otherwise(out)
    return out


def cell_means(rows: DataFrame, domain: str, flagged: str, value: str, excluded: Column, margin: float) -> DataFrame:
    """domain, flagged, n, mean_value, n_excluded and verdict: whether flagged rows are over unflagged ones by the margin."""
    kept = rows.withColumn("_x", F.coalesce(excluded, F.lit(False)))
    cells = kept.groupBy(domain, flagged).agg(F.count_if(~F.col("_x")).alias("n"), F.avg(F.when(~F.col("_x"), F.col(value))).alias("mean_value"), F.count_if(F.col("_x")).alias("n_excluded"))
    both = cells.groupBy(domain).agg(F.max(F.when(F.col(flagged), F.col("mean_value"))).alias("_yes"), F.max(F.when(~F.col(flagged), F.col("mean_value"))).alias("_no"))
    verdict = F.when(F.col("_yes").isNull() | F.col("_no").isNull(), "undecided").when(F.col("_yes") <= F.col("_no") + margin, "alike").otherwise("apart")
    return cells.join(both, domain).select(domain, flagged, "n", "mean_value", "n_excluded", verdict.alias("verdict"))
