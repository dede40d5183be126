"""Shared runs against a look at every window, quotes and statements by hand."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions.runs import by_looking, by_suffixes, longest_run, longest_shared_spans
from tessera.operators import quotes as Q
from tessera.plans.quotes import shared_spans


def look(said, text, least):
    words, text = said.split(), text.lower()
    for n in range(len(words), max(least, 1) - 1, -1):
        for i in range(len(words) - n + 1):
            if " ".join(words[i : i + n]).lower() in text:
                return " ".join(words[i : i + n])
    return None


def test_equals_a_look_at_every_window():
    rng = random.Random(11)
    letters = ["a", "b", "B", "é", " ", " ", ".", "😀", "İ"]
    for _ in range(1500):
        said = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        least = rng.randint(1, 3)
        assert longest_run(said, text, least) == look(said, text, least), (said, text, least)
    assert longest_run("One two THREE", "zone two threefold", 2) == "One two THREE"
    assert longest_run("a a a a", "a a a", 1) == "a a a" and longest_run("x", "", 1) is None and longest_run("", "x", 1) is None


def test_long_texts_that_repeat():
    text = "so it goes " * 8000 + "and ends"
    began = time.time()
    assert longest_run("then " + text, text, 5) == text
    assert longest_run("goes on and on", text, 2) is None
    assert time.time() - began < 60


def test_spans_of_rows(spark):
    rows = [(1, ["It rains a lot here", None, "no"], "Here it RAINS a lot"), (2, None, "x"), (3, ["x y"], None), (4, [], "x")]
    frame = spark.createDataFrame(rows, "k long, said array<string>, body string")
    got = {r["k"]: r["s"] for r in frame.select("k", longest_shared_spans(F.col("said"), F.col("body"), 2).alias("s")).collect()}
    assert got == {1: ["It rains a lot", None, None], 2: None, 3: [None], 4: []}


def test_statements_and_quotes(spark):
    one = lambda f, x: spark.range(1).select(f(F.lit(x).cast("string"))).collect()[0][0]
    assert one(Q.statements, " 1. The knee.\n 2) It is 3.5 cm\nSTEP 4 : swollen ") == ["The knee.", "It is 3.5 cm", "swollen"]
    assert one(Q.statements, " 7. ") == ["7."] and one(Q.statements, "no number") == ["no number"] and one(Q.statements, " \n") == []
    said = "He had “a cough–at  night or so” and 'a cough–at  night or so', not \"too short\"; ‘A Cough-at night or so’."
    assert one(Q.quoted, said) == ["a cough-at night or so", "a cough-at night or so", "A Cough-at night or so"]
    assert one(Q.distinct_quotes, "1. " + said) == ["a cough-at night or so"] and one(Q.quoted, None) is None


def test_profile_of_quotes(spark):
    rows = [
        ("A long walk to the mill.", "The MILL was old.", '1. He took "a long walk to" town.\n2. "the mill was old" they say, "nobody knows it all"'), ("Some case", None, None), (None, "x", "1. y"), ("", "x", "1. y"),
        ("Some case of ﬁve\u00a0words here", None, "some case of five words"),
    ]
    frame = spark.createDataFrame(rows, "body string, paper string, why string")
    got = Q.quote_profile(frame, "body", "paper", "why", 4).collect()[0].asDict()
    assert got == {
        "records": 5, "records_with_quotes": 1, "quotes": 3, "in_case": 1, "in_article": 1, "in_neither": 1, "statements": 3, "with_span": 1, "case_rate": 0.3333, "article_rate": 0.3333, "neither_rate": 0.3333,
        "span_rate": 0.3333, "mean_span_words": 5.0, "mean_quotes": 0.6, "mean_statements": 0.6,
    }
    assert Q.quote_profile(frame.limit(0), "body", "paper", "why").collect()[0]["case_rate"] == 0.0


def test_looking_and_suffixes_agree():
    rng = random.Random(5)
    for _ in range(600):
        lower = "".join(rng.choice("aab ") for _ in range(rng.randint(1, 40))).split()
        text = "".join(rng.choice("aab ") for _ in range(rng.randint(1, 60)))
        least = rng.randint(1, 3)
        first, count = by_suffixes(lower, text) if lower else (0, 0)
        assert by_looking(lower, text, least) == ((first, count) if count >= least else (0, least - 1)), (lower, text, least)


def test_python_holds_few_rows(spark):
    """Batches of 10,000 rows of texts made a worker grow with the table; a text in compatible forms isn't sent again."""
    frame = spark.createDataFrame([("Das Übel ﬁng hier an, so sagt man", "Übel", "1. Das Übel ﬁng hier an")], "body string, paper string, why string")
    for found, passes in ((Q.quote_profile(frame, "body", "paper", "why", 3), 2), (Q.with_spans(frame, "body", "why", 3), 2)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == passes
    assert Q.with_spans(frame, "body", "why", 3).collect()[0]["spans"] == ["Das Übel fing hier an"]


def test_spans_are_found_once(spark):
    plan = shared_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 2
