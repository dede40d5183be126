"""Terms of a table in texts, against a look at each pair."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import terms as T


def test_equals_a_look_at_each_pair(spark, monkeypatch):
    rng = random.Random(6)
    letters = ["a", "b", "B", "1", " ", " ", "-", "é", ".", "ä"]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None), (201, ""), (5, "b ab")]
    terms = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(300)] + [None, "", "  ", "\nab\t", "AB", "a b"]

    def brute(text, term):
        if " " in term:
            return term in text
        return re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", text) is not None

    clean = {t.lower().strip() for t in terms if t and t.strip()}
    want = sorted((k, term) for k, t in texts if t is not None for term in clean if brute(t.lower(), term))
    frame = spark.createDataFrame(texts, "k long, t string").withColumns({"term": F.lit(1), "x": F.lit(2)}).repartition(3)
    table = spark.createDataFrame([(t,) for t in terms], "word string")
    assert sorted(map(tuple, T.term_matches(frame, "k", "t", table, "word").collect())) == want
    monkeypatch.setattr(T, "BLOCK", 40)  # several automata
    assert sorted(map(tuple, T.term_matches(frame, "k", "t", table, "word").collect())) == want
    assert T.term_matches(frame, "k", "t", table.limit(0), "word").collect() == [] and T.term_matches(frame.limit(0), "k", "t", table, "word").collect() == []
