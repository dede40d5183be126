"""Statements of a reasoning, what they quote, and how much of it stands in a case or an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.runs import longest_shared_spans
from tessera.functions.text import compatible, plain_signs, stripped

#: Marks that open and close a quote, its least and greatest length, and how a statement is numbered.
OPENS, CLOSES, EITHER = "\"“‘'", "\"”’'", "\"“”‘’'"
LEAST, MOST = 12, 400
NUMBERED = r"(?i)(?:^|\n)\s*(?:step\s*)?\d+\s*[.):]\s*"


def statements(reasoning: Column) -> Column:
    """Parts between numbers like ``1.``, ``2)`` or ``Step 3:`` at the start of a line; the whole text if nothing is left, none of a blank one."""
    parts = F.filter(F.transform(F.split(reasoning, NUMBERED), stripped), lambda p: p != "")
    whole = F.filter(F.array(stripped(reasoning)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def quoted(text: Column) -> Column:
    """What stands between quote marks of any kind, in order, as often as it does; with plain signs it is to be long enough still."""
    found = F.regexp_extract_all(text, F.lit(f"[{OPENS}]([^{EITHER}]{{{LEAST},{MOST}}})[{CLOSES}]"), F.lit(1))
    return F.filter(F.transform(found, _plain), lambda q: F.length(q) >= LEAST)


def _plain(x: Column) -> Column:
    """Straight quotes, hyphens for dashes and single spaces of a text in compatible forms."""
    return F.trim(F.regexp_replace(F.translate(x, "’‘“”–—", "''\"\"--"), r"(?U)\s+", " "))


def distinct_quotes(reasoning: Column) -> Column:
    """Quotes of all statements in order, each once by its lower case."""
    every = F.flatten(F.transform(statements(reasoning), quoted))
    lower = F.transform(every, F.lower)
    return F.filter(every, lambda q, i: F.array_position(lower, F.lower(q)) == i + 1)


def with_spans(rows: DataFrame, case: str, reasoning: str, least: int = 5) -> DataFrame:
    """``rows`` with statements, and spans: of each statement the longest run of words that the case has, null where it is shorter than ``least`` words. Texts go to one worker each, none to a group."""
    return _with_spans(rows, plain_signs(F.col(case)), compatible(F.col(reasoning)), least)


def _with_spans(rows: DataFrame, case: Column, reasoning: Column, least: int) -> DataFrame:
    """The same of a case and a reasoning that are in compatible forms already, so that no text goes to Python for them twice."""
    found = rows.withColumn("statements", F.transform(statements(reasoning), _plain))
    return found.withColumn("spans", longest_shared_spans(F.col("statements"), case, least))


def quote_profile(rows: DataFrame, case: str, article: str, reasoning: str, least: int = 5) -> DataFrame:
    """One row over all records: quotes, where they stand (in the case, in the article, in neither), statements with a shared span, and means a record.

    Records without a case or a reasoning count as records only. Rates are 0 where there is nothing to divide by.
    """
    there = F.when((plain_signs(F.col(case)) != "") & (F.coalesce(F.col(reasoning), F.lit("")) != ""), compatible(F.col(reasoning)))
    slim = rows.select(plain_signs(F.col(case)).alias("_case"), F.lower(plain_signs(F.coalesce(F.col(article), F.lit("")))).alias("_article"), there.alias("_why"))
    full = _with_spans(slim, F.col("_case"), F.col("_why"), least).withColumns({"_quotes": F.transform(quoted(F.col("_why")), F.lower), "_text": F.lower("_case")})
    n = lambda ok: F.coalesce(F.sum(F.size(F.filter("_quotes", ok)).cast("long")), F.lit(0))
    in_case, in_article = (lambda q: F.contains("_text", q)), (lambda q: F.contains("_article", q))
    spans = F.filter("spans", lambda s: s.isNotNull())
    total = lambda x: F.coalesce(F.sum(F.when(F.col("_why").isNotNull(), x).cast("long")), F.lit(0))
    sums = full.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.size("_quotes") > 0).alias("records_with_quotes"), n(lambda q: F.lit(True)).alias("quotes"), n(in_case).alias("in_case"), n(in_article).alias("in_article"),
        n(lambda q: ~in_case(q) & ~in_article(q)).alias("in_neither"), total(F.size("statements")).alias("statements"), total(F.size(spans)).alias("with_span"),
        total(F.aggregate(spans, F.lit(0), lambda a, s: a + F.size(F.split(s, " ")))).alias("_words"),
    )
    share = lambda a, b, digits=4: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), digits)
    return sums.select(
        *[c for c in sums.columns if c != "_words"], share("in_case", "quotes").alias("case_rate"), share("in_article", "quotes").alias("article_rate"), share("in_neither", "quotes").alias("neither_rate"),
        share("with_span", "statements").alias("span_rate"), share("_words", "with_span", 2).alias("mean_span_words"), share("quotes", "records").alias("mean_quotes"), share("statements", "records").alias("mean_statements"),
    )
