"""Variants of prompts: where a model is read, and what context stands before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import cue_spans, overlapping, put_at
from tessera.operators.generate import context_first, inserted_sentence

NEUTRAL = "The patient arrived at the clinic in the morning."


def _spread(frame: DataFrame, rows: Column) -> DataFrame:
    return frame.withColumn("_v", F.explode(rows)).select(*frame.columns, "_v.*")


def _row(variant: Column | str, prompt: Column, target: Column | None, strategy: str | None = "span_mean", **more: Column) -> Column:
    """A row as a struct: read at the target's text, or at the last token without one."""
    text = F.lit(None).cast("string") if target is None else target
    named = {
        "variant": F.lit(variant) if isinstance(variant, str) else variant, "prompt": prompt, "position_mode": F.lit("last_token" if target is None else "target_text"),
        "target_text": text, "target_text_strategy": F.lit(None if target is None else strategy).cast("string"),
    }
    return F.struct(*[x.alias(n) for n, x in (named | more).items()])


def entity_rows(prompts: DataFrame, prompt: str, target: str, strategies: tuple[str, ...] = ("first_subtoken", "last_subtoken", "span_mean")) -> DataFrame:
    """Each prompt once at its last token and once a strategy at its target."""
    rows = [_row("format_last", F.col(prompt), None), *(_row(f"entity_{s}", F.col(prompt), F.col(target), s) for s in strategies)]
    others = [c for c in prompts.columns if c not in (prompt, target)]
    return prompts.select(*others, F.explode(F.array(*rows)).alias("_v")).select(*others, "_v.*")


def distractor_rows(pairs: DataFrame) -> DataFrame:
    """Nine rows of each pair (original_prompt, distractor_prompt, primary_target, distractor_target): the original, the distractor after and before, and a neutral sentence before.

    A pair may bring its neutral_sentence, its insertion_type, and an id, which becomes base_id and, with the variant, the rows' id.
    """
    own = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in pairs.columns else F.lit(other)
    original, after = F.col("original_prompt"), F.col("distractor_prompt")
    primary, entity = F.col("primary_target"), F.col("distractor_target")
    before = context_first(inserted_sentence(original, after), original)
    neutral = context_first(own("neutral_sentence", NEUTRAL), original)
    specs = [("original", "none", original, ("primary",)), ("after_distractor", "after_primary", after, ("primary", "entity", "format")), ("before_distractor", "before_primary", before, ("primary", "entity", "format")), ("before_neutral", "before_primary", neutral, ("primary", "format"))]
    target = {"primary": primary, "entity": entity, "format": None}
    rows = [_row(f"{condition}_{kind}", prompt, target[kind], condition=F.lit(condition), condition_order=F.lit(order)) for condition, order, prompt, kinds in specs for kind in kinds]
    out = _spread(pairs.withColumn("insertion_type", own("insertion_type", "prepend_sentence")), F.array(*rows))
    return out.withColumns({"base_id": F.col("id"), "id": F.concat(F.col("id").cast("string"), F.lit("__"), F.col("variant"))}) if "id" in pairs.columns else out


def specificity_cases(cases: DataFrame, keys: tuple[str, ...] = ("id", "base_id")) -> DataFrame:
    """``cases`` of either form as one: base_id is the first of ``keys`` that says something, specific_targets the list or the three specific_cue columns, diagnostic_shift "a_to_b" of nonspecific_target and specific_expected unless it is there."""
    have = set(cases.columns)
    said = [F.when(F.col(k).cast("string") != "", F.col(k).cast("string")) for k in keys if k in have]
    three = F.array(*[F.col(f"specific_cue_{i}") for i in (1, 2, 3)]) if "specific_targets" not in have else F.col("specific_targets")
    named = lambda c: F.translate(c, " ", "_")
    shift = F.col("diagnostic_shift") if "diagnostic_shift" in have else F.concat(named(F.col("nonspecific_target")), F.lit("_to_"), named(F.col("specific_expected")))
    return cases.withColumns({"base_id": F.coalesce(*said), "specific_targets": three, "diagnostic_shift": shift}).drop("specific_cue_1", "specific_cue_2", "specific_cue_3")


def control_rows(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` as controls of a kind, with where they come from: control_type, original_id, original_activation_path (null where there is no such column)."""
    of = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({"control_type": F.lit(kind), "original_id": of("id"), "original_activation_path": of("activation_path")})


def specificity_rows(cases: DataFrame) -> DataFrame:
    """Of each case (nonspecific_prompt, specific_prompt, nonspecific_target, specific_targets): three rows, one a specific target, and the full prompt's last token."""
    alone, full, vague = F.col("nonspecific_prompt"), F.col("specific_prompt"), F.col("nonspecific_target")
    none = F.lit(None).cast("int")

    def row(variant: Column | str, condition: str, prompt: Column, target: Column | None, role: str, index: Column = none) -> Column:
        return _row(variant, prompt, target, condition=F.lit(condition), target_role=F.lit(role), cue_index=index)

    head = [row("nonspecific_alone_cue", "nonspecific_alone", alone, vague, "nonspecific_cue"), row("nonspecific_alone_format", "nonspecific_alone", alone, None, "format"), row("specific_full_nonspecific_cue", "specific_full", full, vague, "nonspecific_cue")]
    each = F.transform(F.col("specific_targets"), lambda t, i: row(F.concat(F.lit("specific_full_specific_cue_"), (i + 1).cast("string")), "specific_full", full, t, "specific_cue", (i + 1).cast("int")))
    return _spread(cases, F.concat(F.array(*head), each, F.array(row("specific_full_format", "specific_full", full, None, "format"))))


def span_swaps(cases: DataFrame, prompt: str, cues: str, replacement: str, slots: int) -> DataFrame:
    """Rows (slot, edited, retained) of cases all of whose cues stand in the prompt, without overlap: each of the first min(slots, cues - 2) cues replaced in place; retained are the others."""
    placed = cases.withColumn("_s", cue_spans(F.col(prompt), F.col(cues)))
    whole = placed.where((F.size("_s") == F.size(cues)) & ~F.exists("_s", lambda s: s.isNull()) & ~overlapping(F.col("_s")))
    n = F.least(F.lit(slots), F.size(cues) - 2)
    slotted = whole.where(n > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), n - 1)))
    edited = put_at(F.col(prompt), F.get("_s", F.col("slot")), F.col(replacement))
    kept = F.filter(F.col(cues), lambda c, i: i != F.col("slot"))
    return slotted.withColumns({"edited": edited, "retained": kept}).where(F.forall("retained", lambda c: F.contains("edited", c))).drop("_s")
