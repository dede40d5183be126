"""Training targets as columns: what a readout of a case should say, in three styles, and rows that carry them."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse, escape

#: What stands for cues that aren't there, and the sentences and tags of each style.
NO_CUES = "the clinical cues in the prompt"
DIAGNOSIS_FIRST = ("The activation represents an integrated clinical diagnosis state for ", ". It combines the patient cues, including ", ", toward that diagnosis.")
CUE_THEN_DIAGNOSIS = ("The activation reflects clinical cues such as ", ". Together, these cues support the most likely diagnosis: ", ".")
STRUCTURED = ("<explanation>\n<readout>\n  <task_type>diagnosis</task_type>\n  <answer>", "</answer>\n  <supporting_cues>", "</supporting_cues>\n</readout>\n</explanation>")
CUE_FIRST = ("<explanation>\n<readout>\n<observed>\n", "\n</observed>", "\n<assessment>", "</assessment>", "\n</readout>\n</explanation>")
ASSESSED, UNASSESSED = "Findings most consistent with ", "Findings are non-specific."


def _said(x: Column) -> Column:
    return collapse(F.coalesce(x, F.lit("")))


def _clean(cues: Column) -> Column:
    """Cues collapsed, without empty ones; null as none."""
    return F.filter(F.transform(F.coalesce(cues, F.array().cast("array<string>")), _said), lambda c: c != "")


def label_name(name: Column, aliases: Column, label_id: Column) -> Column:
    """The name, else the first alias, else the id; empty if there is none."""
    first = F.coalesce(F.get(aliases, F.lit(0)), F.lit(""))
    alias = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, _said(first)).otherwise(_said(label_id))
    return F.when(_said(name) != "", _said(name)).otherwise(alias)


def _with_target(cues: Column, target: Column) -> Column:
    said = _said(target)
    return F.when((said != "") & ~F.array_contains(cues, said), F.concat(F.array(said), cues)).otherwise(cues)


def cue_summary(cues: Column, target: Column, most: int) -> Column:
    """The first ``most`` cues, the target in front unless it is one of them, as a phrase."""
    few = F.slice(_with_target(_clean(cues), target), 1, most)
    n = F.size(few)
    several = F.concat(F.array_join(F.slice(few, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(few, n - 1))
    return F.when(n == 0, NO_CUES).when(n == 1, F.get(few, F.lit(0))).otherwise(several)


def _around(parts: tuple[str, ...], *inner: Column) -> Column:
    return F.concat(F.lit(parts[0]), *[x for pair in zip(inner, map(F.lit, parts[1:]), strict=True) for x in pair])


def prose_target(style: Column, name: Column, cues: Column, target: Column, most: int) -> Column:
    """A sentence or two by style (diagnosis_first, cue_then_diagnosis); another style is an error."""
    said = cue_summary(cues, target, most)
    body = F.when(style == "diagnosis_first", _around(DIAGNOSIS_FIRST, name, said)).when(style == "cue_then_diagnosis", _around(CUE_THEN_DIAGNOSIS, said, name))
    body = body.otherwise(F.raise_error(F.concat(F.lit("unknown target style: "), F.coalesce(style, F.lit("null")))).cast("string"))
    return F.concat(F.lit("<explanation>"), body, F.lit("</explanation>"))


def structured_target(name: Column, cues: Column, target: Column, most: int) -> Column:
    """Answer and different cues between tags, signs of mark-up escaped."""
    few = F.slice(_with_target(F.array_distinct(_clean(cues)), target), 1, most)
    listed = F.when(F.size(few) == 0, NO_CUES).otherwise(F.array_join(F.transform(few, escape), "; "))
    return _around(STRUCTURED, escape(_said(name)), listed)


def different(cues: Column) -> Column:
    """Cues collapsed, the first spelling of those that differ in case only."""
    clean = _clean(cues)
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda c, i: F.array_position(lower, F.lower(c)) == i + 1)


def by_hash(cues: Column, seed: int, key: Column) -> Column:
    """Cues in an order of their own for each key: by md5 of seed, key and cue, as other engines give it too."""
    return F.transform(F.array_sort(F.transform(cues, lambda c: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), c).cast("binary")).alias("at"), c.alias("c")))), lambda s: s["c"])


def by_generator(cues: Column, seed: int, key: Column) -> Column:
    """Cues as Python's generator, seeded by "seed:key", shuffles them."""

    @F.pandas_udf("array<int>")
    def order(n: pd.Series, key: pd.Series) -> pd.Series:
        def one(n: int, key: str) -> list[int]:
            out = list(range(n))
            random.Random(f"{seed}:{key}").shuffle(out)
            return out

        return pd.Series([one(a, b) for a, b in zip(n, key, strict=True)])

    return F.transform(order(F.size(cues), F.coalesce(key.cast("string"), F.lit("None"))), lambda i: F.get(cues, i))


def cue_first_target(ordered: Column, most: int, key: Column, assessed: Column | None = None) -> Column:
    """A list of at most ``most`` cues in the order given, with ``assessed``, a label's name, a sentence about it; an error without cues."""
    lines = F.array_join(F.transform(F.slice(ordered, 1, most), lambda c: F.concat(F.lit("- "), escape(c))), "\n")
    named = escape(_said(assessed)) if assessed is not None else None
    said = F.lit("") if named is None else F.concat(F.lit(CUE_FIRST[2]), F.when(named != "", F.concat(F.lit(ASSESSED), named, F.lit("."))).otherwise(UNASSESSED), F.lit(CUE_FIRST[3]))
    missing = F.raise_error(F.concat(F.lit("no cues in row "), F.coalesce(key.cast("string"), F.lit("null")))).cast("string")
    return F.when(F.size(ordered) == 0, missing).otherwise(F.concat(F.lit(CUE_FIRST[0]), lines, F.lit(CUE_FIRST[1]), said, F.lit(CUE_FIRST[4])))


#: Columns that a training row keeps, and the name of its style.
CARRIED = (
    "id", "base_id", "activation_path", "prompt", "variant", "diagnosis_id", "diagnosis_aliases", "cue_targets", "cue_types", "cue_evidence_ids", "source", "patient_id", "layer", "position", "position_family", "position_mode", "target_role",
)
STYLE = "structured_readout_v2_alpha"


def training_rows(cases: DataFrame, split: Column, most: int) -> DataFrame:
    """Structured training rows of ``cases`` (any of CARRIED, diagnosis_name, target_text): columns that they lack are null, a missing base is the row itself."""
    has = lambda c, kind="string": F.col(c) if c in cases.columns else F.lit(None).cast(kind)
    aliases = has("diagnosis_aliases", "array<string>")
    name = label_name(has("diagnosis_name"), aliases, has("diagnosis_id"))
    cues = has("cue_targets", "array<string>")
    if "specific_targets" in cases.columns:
        cues = F.when(F.size(F.coalesce(cues, F.array().cast("array<string>"))) > 0, cues).otherwise(F.col("specific_targets"))
    kinds = {"diagnosis_aliases": "array<string>", "cue_targets": "array<string>", "cue_types": "array<string>", "cue_evidence_ids": "array<string>"}
    kept = {c: has(c, kinds.get(c, "string")) for c in CARRIED} | {"base_id": F.coalesce(has("base_id"), F.col("id"))}
    target = structured_target(name, cues, has("target_text"), most)
    return cases.select(*[x.alias(c) for c, x in kept.items()], split.alias("split"), name.alias("diagnosis_name"), target.alias("target_text"), F.lit(STYLE).alias("target_style"), F.lit("diagnosis").alias("task_type"))
