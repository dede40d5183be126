"""Cases written as prose: built from presentations and labels, gated, and edited in place for counterfactual groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.prompts import as_written, instructed
from tessera.functions.text import asks_reader, cue_spans, is_formula, mentions, overlapping, plain_signs, put_at, segments, slug, stripped, taken_out, without_questions
from tessera.operators.auditing import cue_rules

#: Variants and roles of a counterfactual group, and how its rows are made.
SWAPPED, RETAINED = "swapped_slot", "retained"
METHOD = "span_substitution"


def prose_cases(rows: DataFrame, text: str, label: str, number: str, case_id: str, source: str, least_cues: int = 3, words: tuple[int, int] = (4, 25), most_cues: int | None = None, drop_named: bool = True) -> DataFrame:
    """A case of each row with a text and a label that has at least ``least_cues`` clauses of ``words`` words.

    Questions to the reader go first. Rows whose text names the label give none, unless ``drop_named`` is off. ``number`` tells cases of a label
    apart. Null or blank texts and labels give none; rows repeated whole give a case each, with one id.
    """
    clean = rows.select(F.col(number).alias("_n"), F.col(case_id).cast("string").alias("case_id"), without_questions(plain_signs(F.col(text))).alias("presentation"), stripped(F.col(label)).alias("diagnosis_name"))
    clean = clean.where("presentation <> '' AND diagnosis_name <> ''")
    if drop_named:
        clean = clean.where(~mentions(F.col("presentation"), F.col("diagnosis_name")))
    cut = clean.withColumn("cue_targets", segments(F.col("presentation"), *words, most_cues)).where(F.size("cue_targets") >= least_cues)
    cut = cut.withColumn("diagnosis_id", slug(F.col("diagnosis_name")))
    base = F.format_string(f"{source}_%s_%07d", "diagnosis_id", "_n")
    prefix = as_written(F.col("presentation"))
    return cut.select(
        F.concat(base, F.lit("__cues_all")).alias("id"), base.alias("base_id"), F.lit(source).alias("source"), "case_id", F.lit("cue_count_all").alias("variant"),
        *[instructed(prefix, F.lit(how)).alias(name) for name, how in (("prompt", "direct"), ("prompt_cot", "cot"))],
        "presentation", "diagnosis_id", "diagnosis_name", F.array("diagnosis_name").alias("diagnosis_aliases"), "cue_targets", F.size("cue_targets").alias("cue_count"),
        F.size("cue_targets").alias("available_cue_count"), F.transform("cue_targets", lambda c: F.lit("clinical_span")).alias("cue_types"), F.transform("cue_targets", is_formula).alias("cue_is_boilerplate"),
    )


def asked(text: Column, cues: Column) -> Column:
    """Whether a text puts a question to the reader, or a cue would be one with a question mark."""
    return asks_reader(text) | F.exists(cues, lambda c: asks_reader(F.concat(c, F.lit("?"))))


def prose_rules(text: str, prompt: str, cues: str, label: str) -> dict[str, Column]:
    """What ``auditing.violations`` looks for in a case: faults of its cues (one within another is none), a question to the reader, a label that is named."""
    faults = {name: found for name, found in cue_rules(cues, prompt).items() if name != "nested"}
    return faults | {"reader_question": asked(F.col(text), F.col(cues)), "named_label": mentions(F.col(text), F.col(label))}


def near_constant(cases: DataFrame, cues: str, share: float = 0.5) -> DataFrame:
    """cue, n, rate: cues that stand at least ``share`` times as often as there are cases. A cue is counted before it is compared, so no case meets another."""
    counts = cases.select(F.explode(cues).alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n"))
    total = cases.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("_all")).select("cue", "n", (F.col("n") / F.col("_all")).alias("rate"))


def prose_summary(cases: DataFrame, text: str, cues: str, label: str) -> DataFrame:
    """One row: cases, cue occurrences, different cues, shares of those seen once, of cases with the most common, of formulas; cases that name the label or ask the reader. 0 where there is nothing to divide by."""
    by_cue = cases.select(F.explode(cues).alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n"))
    cue_sums = by_cue.agg(F.count(F.lit(1)).alias("distinct_cues"), F.coalesce(F.sum("n"), F.lit(0)).alias("cue_occurrences"), F.count_if(F.col("n") == 1).alias("_once"), F.max("n").alias("_most"), F.sum(F.when(is_formula(F.col("cue")), F.col("n"))).alias("_formula"))
    sums = cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(mentions(F.col(text), F.col(label))).alias("named_label"), F.count_if(asked(F.col(text), F.col(cues))).alias("reader_question"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 4)
    both = sums.crossJoin(cue_sums)  # one row and one row
    return both.select("n_cases", "cue_occurrences", "distinct_cues", part("_once", "distinct_cues").alias("once_rate"), part("_most", "n_cases").alias("most_common_rate"), part("_formula", "cue_occurrences").alias("formula_rate"), "named_label", "reader_question")


def swap_slots(cases: DataFrame, base: str, prompt: str, cues: str, slots: int = 2, seed: str = "17") -> DataFrame:
    """``cases`` once for each slot to swap, with slot, swap_group and the two slots retained; blank cues don't count.

    Cases have three cues or more, all in the prompt without overlap; min(slots, cues - 2) slots are taken, in order of md5 of seed, base and
    slot, and for each the two others that come first by md5 of seed, base, slot and their own.
    """
    used = F.filter(F.col(cues), lambda c: stripped(c) != "")
    whole = cases.withColumn(cues, used).where((F.size(cues) >= 3) & (F.col(prompt) != "")).withColumn("_spans", cue_spans(F.col(prompt), F.col(cues)))
    whole = whole.where(~F.exists("_spans", lambda s: s.isNull()) & ~overlapping(F.col("_spans")))
    key = F.concat_ws(":", F.lit(seed), F.col(base).cast("string"))

    def mixed(numbers: Column, *before: Column) -> Column:
        put = F.transform(numbers, lambda i: F.struct(F.md5(F.concat_ws(":", key, *before, i.cast("string")).cast("binary")), i.alias("i")))
        return F.transform(F.array_sort(put), lambda s: s["i"])

    every = F.sequence(F.lit(0), F.size(cues) - 1)
    chosen = F.array_sort(F.slice(mixed(every), F.lit(1), F.least(F.lit(slots), F.size(cues) - 2)))
    rows = whole.withColumn("slot", F.explode(chosen))
    others = F.filter(every, lambda i: i != F.col("slot"))
    group = F.concat(F.col(base).cast("string"), F.format_string("__g%02d", "slot"))
    return rows.withColumns({"swap_group": group, "retained": F.slice(mixed(others, F.col("slot").cast("string")), 1, 2)})


def span_groups(slots: DataFrame, base: str, prompt: str, cues: str, replacement: str, strategy: str = "last_subtoken") -> DataFrame:
    """Eight rows of each row of ``swap_slots`` that has a replacement: the slot as it is and swapped, and both retained slots as they are, beside the swap and beside the removal.

    All eight, or none if a gold cue isn't in its row's prompt. Prompts differ from the case's in the slot's span only (a removal is tidied). A row
    is read at the first place of its gold. Columns of ``slots`` that aren't named here are carried.
    """
    c, p, slot, other = F.col(cues), F.col(prompt), F.col("slot"), F.col(replacement)
    span, old = F.get("_spans", slot), F.get(c, slot)
    shown = {"orig": p, "swap": put_at(p, span, other), "removed": taken_out(p, span)}

    def row(variant: str, role: str, at: Column, gold: Column) -> Column:
        return F.struct(F.lit(variant).alias("cf_variant"), F.lit(role).alias("cf_role"), shown[variant].alias("prompt"), at.alias("cf_slot"), gold.alias("cue_text"))

    rows = [row("orig", SWAPPED, slot, old), row("swap", SWAPPED, slot, other)]
    for k in (0, 1):
        at = F.get("retained", F.lit(k))
        rows += [row(v, RETAINED, at, F.get(c, at)) for v in shown]
    named = {base, prompt, cues, replacement, "slot", "swap_group", "retained", "_spans"}
    carried = [n for n in slots.columns if n not in named]
    found = slots.where(other.isNotNull()).withColumn("_rows", F.array(*rows))
    whole = found.where(F.forall("_rows", lambda r: F.contains(r["prompt"], r["cue_text"])))
    out = whole.select(*carried, F.col(base).cast("string").alias("base_id"), "swap_group", slot, old.alias("cf_original_cue"), other.alias("cf_replacement_cue"), F.explode("_rows").alias("_r"))
    ids = F.concat("base_id", F.lit("__cf_"), F.col("_r.cf_variant"), F.format_string("__slot%02d__g%02d", "_r.cf_slot", "slot"))
    return out.select(
        *carried, ids.alias("id"), "base_id", F.concat(F.lit("cue_counterfactual_"), F.col("_r.cf_variant")).alias("variant"), "_r.*", F.lit(METHOD).alias("cf_method"), F.lit("cue").alias("target_role"),
        F.array("_r.cue_text").alias("cue_targets"), F.lit("target_text").alias("position_mode"), F.col("_r.cue_text").alias("target_text"), F.lit(strategy).alias("target_text_strategy"), F.lit(0).alias("target_text_occurrence"),
        "cf_original_cue", "cf_replacement_cue", F.col("cf_original_cue").alias("cf_removed_cue"), F.col("swap_group").alias("cf_swap_group"),
    )
