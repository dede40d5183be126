"""Names that count as a hit: a row's own or those of a lookup table, a donor's beside the original's, and what kinds of cue a case's answers shift on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse, terms_in

#: How a variant's name tells what it asks at, in order of what a case counts as, and that class.
FORMAT, NONSPECIFIC, SPECIFIC = "specific_full_format", "specific_full_nonspecific_cue", "specific_full_specific_cue_"
SHIFTS = ("format_shift", "nonspecific_cue_shift", "specific_cue_only")
NO_SHIFT = "no_specific_signal"


def _none() -> Column:
    return F.array().cast("array<string>")


def donor_names(name: Column, aliases: Column, label_id: Column) -> Column:
    """Name, aliases and the id with spaces for underscores, collapsed; the first spelling of those that differ in case only."""
    said = lambda x: collapse(F.coalesce(x, F.lit("")))
    every = F.concat(F.array(said(name)), F.transform(F.coalesce(aliases, _none()), said), F.array(F.translate(said(label_id), "_", " ")))
    full = F.filter(every, lambda x: x != "")
    lower = F.transform(full, F.lower)
    return F.filter(full, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def donor_hits(rows: DataFrame, answer: str, output: str) -> DataFrame:
    """``rows`` (donor_name, donor_aliases, donor_id) with donor_names, and whether answer and output have one; null where there is no donor."""
    names = rows.withColumn("donor_names", donor_names(F.col("donor_name"), F.col("donor_aliases"), F.col("donor_id")))
    hit = lambda x: F.when(F.size("donor_names") > 0, F.size(terms_in(F.coalesce(F.col(x), F.lit("")), F.col("donor_names"))) > 0)
    return names.withColumns({"donor_answer_hit": hit(answer), "donor_output_hit": hit(output)})


def resolved(rows: DataFrame, key: str, field: str, known: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``field`` as their own aliases, else those that ``known`` (``key``, aliases; one row a key) has, and after either those of ``more``; each once."""
    found = rows.join(known.select(key, F.col("aliases").alias("_known")), key, "left")
    own = F.when(F.size(F.coalesce(F.col(field), _none())) > 0, F.col(field)).otherwise(F.coalesce(F.col("_known"), _none()))
    if more is not None:
        found = found.join(more.select(key, F.col("aliases").alias("_more")), key, "left")
        own = F.concat(own, F.coalesce(F.col("_more"), _none()))
    return found.withColumn(field, F.array_distinct(own)).drop("_known", "_more").select(*rows.columns)


def alias_hits(rows: DataFrame, text: str, families: list[str]) -> DataFrame:
    """``rows`` with ``family``_hits and ``family``_hit of each family, a column ``family``_aliases of terms."""
    out = rows.withColumns({f"{f}_hits": terms_in(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(f"{f}_aliases"), _none())) for f in families})
    return out.withColumns({f"{f}_hit": F.size(f"{f}_hits") > 0 for f in families})


def shifts(rows: DataFrame, case: str, variant: str, hit: str) -> DataFrame:
    """``case`` and shift: where its rows hit first, at the format's position, at the unspecific cue, or at a specific one only."""
    at = lambda ok: F.coalesce(F.bool_or(ok & F.col(hit)), F.lit(False))
    v = F.col(variant)
    seen = rows.groupBy(case).agg(at(v == FORMAT).alias("_0"), at(v == NONSPECIFIC).alias("_1"), at(F.startswith(v, F.lit(SPECIFIC))).alias("_2"))
    return seen.select(case, F.when(F.col("_0"), SHIFTS[0]).when(F.col("_1"), SHIFTS[1]).when(F.col("_2"), SHIFTS[2]).otherwise(NO_SHIFT).alias("shift"))
