"""Row generators: cases to the rows that are asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import counted_cue_spans


def cue_and_format_rows(cases: DataFrame, cues: str, most: int) -> DataFrame:
    """``cases`` exploded: single_cue and single_format of the first cue, multi_cue_1..k and multi_format of the first ``most``; cases without a cue give none."""
    used = F.slice(F.col(cues), 1, most)
    row = lambda variant, mode, target, strategy: F.struct(variant.alias("variant"), F.lit(mode).alias("position_mode"), target.alias("target_text"), F.lit(strategy).alias("strategy"))
    none = F.lit(None).cast("string")
    multi = F.transform(used, lambda c, i: row(F.concat(F.lit("multi_cue_"), (i + 1).cast("string")), "target_text", c, "span_mean"))
    first = F.get(used, F.lit(0))
    rows = F.concat(
        F.array(row(F.lit("single_cue"), "target_text", first, "span_mean"), row(F.lit("single_format"), "last_token", none, "last_token")),
        multi,
        F.array(row(F.lit("multi_format"), "last_token", none, "last_token")),
    )
    return cases.where(F.size(used) > 0).withColumn("_r", F.explode(rows)).select(*cases.columns, "_r.*")


def by_count(cases: DataFrame, cues: str, counts: list[int | None], place: Column) -> DataFrame:
    """A row a count that the case has cues for (None: all, in their order; else the first so many by ``place`` of a cue)."""
    mixed = F.transform(F.array_sort(F.transform(F.col(cues), lambda c: F.struct(F.md5(F.concat(place, F.lit(":"), c).cast("binary")).alias("h"), c.alias("c")))), lambda s: s["c"])
    rows = [F.struct(F.lit("all" if n is None else str(n)).alias("cue_count"), (F.col(cues) if n is None else F.slice(mixed, 1, n)).alias("chosen"), F.lit(n or 0).alias("_need")) for n in counts]
    out = cases.withColumn("_r", F.explode(F.array(*rows))).where(F.size(F.col(cues)) >= F.col("_r._need"))
    return out.select(*cases.columns, "_r.cue_count", "_r.chosen")


def position_rows(cases: DataFrame, prompt: str, cues: str) -> DataFrame:
    """A row a cue that is in the prompt: cue_index (from 0), cue, start, end, occurrence (places of the cue before its own)."""
    spans = cases.withColumn("_s", counted_cue_spans(F.col(prompt), F.col(cues)))
    out = spans.select(*cases.columns, F.posexplode("_s").alias("cue_index", "_span")).where("_span IS NOT NULL").withColumn("cue", F.get(F.col(cues), F.col("cue_index")))
    return out.select(*cases.columns, "cue_index", "cue", *[F.col("_span")[n].alias(n) for n in ("start", "end", "occurrence")])


def joined_prompt(cues: Column) -> Column:
    return F.concat(F.array_join(cues, ", "), F.lit("."))


def with_replacement(cases: DataFrame, base: str, cues: str, vocabulary: DataFrame) -> DataFrame:
    """``cases`` with replacement: one of all different ones of ``vocabulary`` by hash of ``base``, or the next one that is none of the case's cues in any case; cases without one are left out.

    Spellings that differ in case only are one, its least. They are numbered by counts of ranges of their hash and places within one; what a
    case rules out are the numbers of its own cues, so it looks up its cues and one replacement, however large the vocabulary is.
    """
    spelt = vocabulary.where("replacement IS NOT NULL").groupBy(F.lower("replacement").alias("_low")).agg(F.min("replacement").alias("replacement"))
    known = spelt.withColumn("_h", F.xxhash64("_low")).withColumn("_r", F.shiftright("_h", 48))
    sizes = known.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", "_low")) - 1
    numbered = known.join(sizes, "_r").select((F.col("_before") + place).alias("_number"), "_low", "replacement")
    total = spelt.agg(F.count(F.lit(1)).alias("_all")).where("_all > 0")  # one row
    own = cases.select(base, F.explode(F.transform(F.col(cues), F.lower)).alias("_low")).distinct()
    taken = own.join(numbered, "_low").groupBy(base).agg(F.collect_set("_number").alias("_taken"))
    asked = cases.select(base).distinct().join(taken, base, "left").crossJoin(F.broadcast(total))
    none = F.array().cast("array<long>")
    asked = asked.withColumn("_taken", F.coalesce("_taken", none)).withColumn("_tries", F.sequence(F.lit(0).cast("long"), F.least(F.col("_all") - 1, F.size("_taken"))))
    tried = F.transform("_tries", lambda t: F.pmod(F.xxhash64(base) + t, F.col("_all")))
    free = asked.select(base, F.get(F.array_except(tried, F.col("_taken")), F.lit(0)).alias("_number")).where("_number IS NOT NULL")
    return cases.join(free.join(numbered.select("_number", "replacement"), "_number").select(base, "replacement"), base)


def counterfactual_rows(cases: DataFrame, base: str, cues: str, replacement: str) -> DataFrame:
    """Eight rows a case of three cues or more: the first slot swapped or read as it is, and two slots kept under no change, swap and removal.

    slot is the slot in the case itself for all variants, so that pairs of a slot meet.
    """
    c, other = F.col(cues), F.col(replacement)
    h = F.conv(F.substring(F.md5(F.col(base).cast("string").cast("binary")), 1, 6), 16, 10).cast("int")
    cases = cases.where((F.size(c) >= 3) & other.isNotNull()).withColumn("_slot", F.pmod(h, F.size(c)))
    slot = F.col("_slot")
    swapped = F.transform(c, lambda v, i: F.when(i == slot, other).otherwise(v))
    removed = F.filter(c, lambda v, i: i != slot)
    row = lambda variant, role, shown, at, gold: F.struct(F.lit(variant).alias("variant"), F.lit(role).alias("role"), joined_prompt(shown).alias("prompt"), at.alias("slot"), gold.alias("gold"))
    rows = [row("orig", "swapped_slot", c, slot, F.get(c, slot)), row("swap", "swapped_slot", swapped, slot, other)]
    for step in (1, 2):
        at = F.pmod(slot + step, F.size(c))
        gold = F.get(c, at)
        rows += [row("orig", "retained", c, at, gold), row("swap", "retained", swapped, at, gold), row("removed", "retained", removed, at, gold)]
    out = cases.withColumn("original_cue", F.get(c, slot)).withColumn("replacement_cue", other).withColumn("_r", F.explode(F.array(*rows)))
    return out.select(base, "original_cue", "replacement_cue", "_r.*")


def context_first(context: Column, prompt: Column) -> Column:
    """The context, closed by a period if it has no end mark, before the prompt."""
    c = F.btrim(context)
    return F.concat(F.when(c.rlike("[.!?]$"), c).otherwise(F.concat(c, F.lit("."))), F.lit(" "), prompt)


def inserted_sentence(original: Column, changed: Column, marker: Column | None = None) -> Column:
    """What ``changed`` has between the sentences of ``original`` and its closing question, or at an end, else its sentence with ``marker``; an error if none fits."""
    question = F.btrim(F.substring_index(original, ".", -1))
    prefix = F.btrim(F.substring(original, F.lit(1), F.length(original) - F.length(F.substring_index(original, ".", -1))))
    between = F.btrim(F.substring(changed, F.length(prefix) + 1, F.length(changed) - F.length(prefix) - F.length(question)))
    behind = F.btrim(F.substring(changed, F.length(original) + 1, F.length(changed)))
    before = F.btrim(F.substring(changed, F.lit(1), F.length(changed) - F.length(original)))
    out = F.when(F.startswith(changed, original), behind).when(F.endswith(changed, original), before).when((question != "") & F.startswith(changed, prefix) & F.endswith(changed, question), between)
    if marker is not None:
        found = F.filter(F.transform(F.split(changed, r"\."), lambda s: F.btrim(s)), lambda s: (s != "") & F.contains(F.lower(s), F.lower(marker)))
        out = F.coalesce(out, F.concat(F.get(found, F.lit(0)), F.lit(".")))
    return F.coalesce(out, F.raise_error(F.lit("no sentence was inserted")).cast("string"))
