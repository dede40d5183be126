"""Row generators over the driver tables: cues of a document are its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import and_list, numbered
from tessera.operators import generate as G
from tessera.operators.judging import counterfactual_rates
from tessera.plans.catalogue import query, table


def _first_lines(n: int | None) -> Column:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s)), lambda s: s != "")
    return lines if n is None else F.slice(lines, 1, n)


def _cases(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", _first_lines(n).alias("cues"))


_CASES = "SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS cues FROM documents"


@query(
    "variant_rows",
    f"""WITH c AS ({_CASES}), r AS (SELECT doc_id, unnest([{{'variant': 'single_cue', 'position_mode': 'target_text', 'target_text': cues[1]}}, {{'variant': 'single_format', 'position_mode': 'last_token', 'target_text': NULL}}]
  || list_transform(range(1, len(cues) + 1), lambda i: {{'variant': 'multi_cue_' || i, 'position_mode': 'target_text', 'target_text': cues[i]}}) || [{{'variant': 'multi_format', 'position_mode': 'last_token', 'target_text': NULL}}]) AS r FROM c WHERE len(cues) > 0)
SELECT doc_id, r.variant AS variant, r.position_mode AS position_mode, r.target_text AS target_text FROM r""",
)
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cue_and_format_rows(_cases(spark, sf_dir), "cues", 2**31 - 1).select("doc_id", "variant", "position_mode", "target_text")


@query(
    "count_rows",
    f"""WITH c AS ({_CASES}), r AS (SELECT doc_id, '2' AS cue_count, array_to_string(list_transform(list_sort(list_transform(cues, lambda c: {{'h': md5(doc_id || ':' || c), 'c': c}}))[1:2], lambda s: s.c), ' + ') AS chosen FROM c WHERE len(cues) >= 2)
SELECT * FROM r UNION ALL SELECT doc_id, 'all', array_to_string(cues, ' + ') FROM c""",
)
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.by_count(_cases(spark, sf_dir), "cues", [2, None], F.col("doc_id").cast("string"))
    return rows.select("doc_id", "cue_count", F.array_join("chosen", " + ").alias("chosen"))


@query(
    "position_rows",
    """WITH c AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1] AS cue FROM documents)
SELECT doc_id, 0 AS cue_index, strpos(text, cue) - 1 AS start, strpos(text, cue) - 1 + length(cue) AS "end", 0 AS occurrence FROM c WHERE cue IS NOT NULL""",
)
def position_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.position_rows(_cases(spark, sf_dir, 1), "text", "cues").select("doc_id", "cue_index", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "occurrence")


@query(
    "position_rows_all",
    f"""WITH RECURSIVE c AS ({_CASES}),
s AS (SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS nxt, NULL::BIGINT AS pos, 0::BIGINT AS size FROM c UNION ALL
  SELECT doc_id, i, CASE WHEN p > 0 THEN p + size ELSE nxt END, p, size FROM (SELECT s.doc_id, s.i + 1 AS i, s.nxt, length(cues[s.i + 1]) AS size, CASE WHEN strpos(substr(text, s.nxt), cues[s.i + 1]) > 0 THEN strpos(substr(text, s.nxt), cues[s.i + 1]) + s.nxt - 1 ELSE strpos(text, cues[s.i + 1]) END AS p FROM s JOIN c USING (doc_id) WHERE s.i < len(cues)))
SELECT doc_id, (i - 1)::INT AS cue_index, (pos - 1)::INT AS start, (pos - 1 + size)::INT AS "end", ((pos - 1 - length(replace(left(text, pos - 1), cues[i], ''))) // size)::INT AS occurrence FROM s JOIN c USING (doc_id) WHERE i > 0 AND pos > 0""",
)
def position_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all lines, each sought from where the one before it ended."""
    return G.position_rows(_cases(spark, sf_dir), "text", "cues").select("doc_id", "cue_index", "start", "end", "occurrence")


@query("prompt_lists", f"WITH c AS ({_CASES}) SELECT doc_id, CASE WHEN len(cues) <= 2 THEN array_to_string(cues, ' and ') ELSE array_to_string(cues[1:len(cues) - 1], ', ') || ', and ' || cues[-1] END AS joined, array_to_string(list_transform(range(1, len(cues) + 1), lambda i: i || '. ' || cues[i]), chr(10)) AS options FROM c")
def prompt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("doc_id", and_list(F.col("cues")).alias("joined"), numbered(F.col("cues")).alias("options"))


def _counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "benchmark").select(F.substring_index("text", ".", 1).alias("replacement"))
    return G.counterfactual_rows(G.with_replacement(_cases(spark, sf_dir), "doc_id", "cues", other), "doc_id", "cues", "replacement")


@query("counterfactual_rows")
def counterfactual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counterfactuals(spark, sf_dir)


@query("counterfactual_rates")
def counterfactual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over rows that are read back as their own prompts: what is there is read, what was swapped or removed isn't."""
    return counterfactual_rates(_counterfactuals(spark, sf_dir).withColumn("observed", F.col("prompt")), "doc_id", "observed", 0.5)
