"""Reasonings that quote their cases, over conversations: lines of an answer as numbered statements, the last of which quotes the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import quotes as Q
from tessera.plans.catalogue import query, table

_REASONED = r"""p AS (SELECT a.conv_id, a.turn, a.text AS body, b.text AS reply, regexp_split_to_array(b.text, '\n') AS lines FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
r AS (SELECT conv_id, turn, trim(regexp_replace(body, '\s+', ' ', 'g')) AS body, trim(regexp_replace(reply, '\s+', ' ', 'g')) AS article,
  list_transform(list_filter(list_transform(range(1, len(lines) + 1), lambda i: trim(lines[i])), lambda l: l <> ''), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))) || [trim(regexp_replace('It says "' || substr(body, 1 + turn, 60) || '" and ''' || substr(reply, 3, 15 + turn) || '''', '\s+', ' ', 'g'))] AS stated,
  list_filter([trim(regexp_replace(substr(body, 1 + turn, 60), '\s+', ' ', 'g')), trim(regexp_replace(substr(reply, 3, 15 + turn), '\s+', ' ', 'g'))], lambda q: length(q) >= 12) AS quoted FROM p),
w AS (SELECT conv_id, turn, body, unnest(range(1, len(stated) + 1)) AS i, string_split(stated[i], ' ') AS ws FROM r),
f AS (SELECT conv_id, turn, body, i, ws, unnest(range(1, len(ws) + 1)) AS s FROM w), g AS (SELECT *, unnest(range(s + 4, len(ws) + 1)) AS e FROM f),
h AS (SELECT conv_id, turn, i, e - s + 1 AS n, arg_min(array_to_string(ws[s:e], ' '), s) AS span FROM g WHERE contains(lower(body), lower(array_to_string(ws[s:e], ' '))) GROUP BY ALL),
spans AS (SELECT conv_id, turn, i - 1 AS place, max(n) AS n, arg_max(span, n) AS span FROM h GROUP BY ALL)"""


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    lines = F.filter(F.split("reply", "\n"), lambda x: F.trim(x) != "")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise(") "), x)), "\n")
    own, other = F.substring("text", F.col("turn").cast("int") + 1, F.lit(60)), F.substring("reply", F.lit(3), F.col("turn").cast("int") + 15)
    why = F.concat(numbered, F.lit("\n Step 99: It says “"), own, F.lit("” and '"), other, F.lit("'"))
    return turns.join(after, ["conv_id", "turn"]).withColumn("why", why)


@query("shared_spans", f"WITH {_REASONED} SELECT conv_id, turn, place::INT AS place, span FROM spans")
def shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's longest run of five words or more of the question."""
    # outer, as Spark would otherwise find the spans once more beforehand to leave out rows without any
    found = Q.with_spans(_reasoned(spark, sf_dir), "text", "why").select("conv_id", "turn", F.posexplode_outer("spans").alias("place", "span"))
    return found.where("span IS NOT NULL")


@query(
    "quote_profile",
    f"""WITH {_REASONED}, q AS (SELECT *, unnest(quoted) AS quote FROM r),
a AS (SELECT count(*) AS quotes, count(*) FILTER (contains(lower(body), lower(quote))) AS in_case, count(*) FILTER (contains(lower(article), lower(quote))) AS in_article, count(*) FILTER (NOT contains(lower(body), lower(quote)) AND NOT contains(lower(article), lower(quote))) AS in_neither FROM q),
b AS (SELECT count(*) AS records, count(*) FILTER (len(quoted) > 0) AS records_with_quotes, sum(len(stated))::BIGINT AS statements FROM r), c AS (SELECT count(*) AS with_span, sum(n) AS words FROM spans)
SELECT records, records_with_quotes, quotes, in_case, in_article, in_neither, statements, with_span, round(in_case / quotes, 4) AS case_rate, round(in_article / quotes, 4) AS article_rate, round(in_neither / quotes, 4) AS neither_rate,
  round(with_span / statements, 4) AS span_rate, round(words / with_span, 2) AS mean_span_words, round(quotes / records, 4) AS mean_quotes, round(statements / records, 4) AS mean_statements FROM a, b, c""",
)
def quote_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quote_profile(_reasoned(spark, sf_dir), "text", "reply", "why")
