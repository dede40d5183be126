"""Cases of prose, their gates and groups of edited spans over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import prose as P
from tessera.operators.auditing import violations
from tessera.plans.catalogue import query, table


def _presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the first word of three letters or more of their answers as what they are about."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.regexp_extract("text", r"(\p{L}{3,})", 1).alias("label"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    return turns.where("role = 'user'").join(after, ["conv_id", "turn"]).select(number.alias("number"), "text", "label")


def _cases(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return P.prose_cases(_presentations(spark, sf_dir), "text", "label", "number", "number", "talk", **how)


@query("prose_cases")
def prose_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of all questions, whole texts."""
    return _cases(spark, sf_dir)


@query("prose_gates")
def prose_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two clauses or more that break a rule, those that name their label among them."""
    return violations(_cases(spark, sf_dir, least_cues=2, drop_named=False), "id", P.prose_rules("presentation", "prompt", "cue_targets", "diagnosis_name"))


@query("prose_profile")
def prose_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prose_summary(_cases(spark, sf_dir, least_cues=2, drop_named=False), "presentation", "cue_targets", "diagnosis_name")


_PLACES = r"""WITH RECURSIVE c AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS cues FROM documents),
k AS (SELECT * FROM c WHERE len(cues) >= 3),
s AS (SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS nxt, NULL::BIGINT AS pos, NULL::BIGINT AS stop FROM k UNION ALL
  SELECT doc_id, i, p + size, p, p + size FROM (SELECT s.doc_id, s.i + 1 AS i, length(cues[s.i + 1]) AS size, CASE WHEN strpos(substr(text, s.nxt), cues[s.i + 1]) > 0 THEN strpos(substr(text, s.nxt), cues[s.i + 1]) + s.nxt - 1 ELSE strpos(text, cues[s.i + 1]) END AS p FROM s JOIN k USING (doc_id) WHERE s.i < len(cues))),
places AS (SELECT * FROM s WHERE i > 0),
clash AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, stop > lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, stop) AS crossed FROM places) WHERE crossed),
w AS (SELECT k.* FROM k ANTI JOIN clash USING (doc_id)),
h AS (SELECT doc_id, i - 1 AS slot, row_number() OVER (PARTITION BY doc_id ORDER BY md5('17:' || doc_id || ':' || (i - 1))) AS place FROM w JOIN places USING (doc_id)),
t AS (SELECT h.doc_id, h.slot, w.text, w.cues, p.pos, p.stop, b.text AS other FROM h JOIN w USING (doc_id) JOIN places p ON p.doc_id = h.doc_id AND p.i = h.slot + 1 JOIN benchmark b ON b.item_id = (h.doc_id + h.slot) % (SELECT count(*) FROM benchmark) WHERE h.place <= least(2, len(w.cues) - 2)),
o AS (SELECT t.doc_id, t.slot, r.i - 1 AS kept, row_number() OVER (PARTITION BY t.doc_id, t.slot ORDER BY md5('17:' || t.doc_id || ':' || t.slot || ':' || (r.i - 1))) AS place FROM t JOIN places r ON r.doc_id = t.doc_id AND r.i <> t.slot + 1),
e AS (SELECT *, left(text, pos - 1) || other || substr(text, stop) AS swapped, regexp_replace(replace(replace(replace(replace(left(text, pos - 1) || substr(text, stop), '  ', ' '), ' ,', ','), ' .', '.'), ', ,', ','), '^\s+|\s+$', '', 'g') AS removed FROM t),
z AS (SELECT doc_id, slot, 'orig' AS cf_variant, 'swapped_slot' AS cf_role, slot AS cf_slot, text AS prompt, cues[slot + 1] AS cue FROM e UNION ALL SELECT doc_id, slot, 'swap', 'swapped_slot', slot, swapped, other FROM e
  UNION ALL SELECT doc_id, slot, v.n, 'retained', kept, CASE v.n WHEN 'orig' THEN text WHEN 'swap' THEN swapped ELSE removed END, cues[kept + 1] FROM e JOIN o USING (doc_id, slot) CROSS JOIN (VALUES ('orig'), ('swap'), ('removed')) v(n) WHERE place <= 2),
g AS (SELECT *, min(contains(prompt, cue)::INT) OVER (PARTITION BY doc_id, slot) AS whole FROM z)
SELECT doc_id || '__cf_' || cf_variant || '__slot' || lpad(cf_slot::VARCHAR, greatest(2, length(cf_slot::VARCHAR))::INT, '0') || '__g' || lpad(slot::VARCHAR, greatest(2, length(slot::VARCHAR))::INT, '0') AS id, cf_role, md5(prompt) AS prompt, md5(cue) AS cue FROM g WHERE whole = 1"""


@query("span_groups", _PLACES)
def span_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight over all lines of all documents, two slots each, swapped for items of the benchmark."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s)), lambda s: s != "")
    slots = P.swap_slots(table(spark, sf_dir, "documents").select("doc_id", "text", lines.alias("cues")), "doc_id", "text", "cues")
    benchmark = table(spark, sf_dir, "benchmark")
    items = benchmark.agg(F.count(F.lit(1)).alias("_n"))  # one row
    numbered = slots.crossJoin(F.broadcast(items)).withColumn("_item", F.pmod(F.col("doc_id") + F.col("slot"), F.col("_n"))).drop("_n")
    placed = numbered.join(benchmark.select(F.col("item_id").alias("_item"), F.col("text").alias("other")), "_item").drop("_item")
    return P.span_groups(placed, "doc_id", "text", "cues", "other").select("id", "cf_role", F.md5("prompt").alias("prompt"), F.md5("cue_text").alias("cue"))
