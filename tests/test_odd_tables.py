"""Queries against their SQL on small odd tables."""

import duckdb
import pytest
from tessera.plans import catalogue

from tests.test_queries import rows


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives what its SQL gives of tables made of rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, (given, schema) in tables.items():
            spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLES[name]).df()
        assert rows(got) == rows(want)
        return got

    return check


TURNS = "conv_id long, turn int, role string, text string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sentences_are_quoted_as_often_as_they_stand(agrees):
    said = "Twelve signs it is. And twelve signs it is indeed. Twelve signs it is. Short.\n It “said” so \"itself\" to\n  me"
    found = agrees("quote_statistics", conversations=([(1, 0, "user", said), (1, 1, "assistant", "So: twelve signs it is, it “said” so"), (2, 0, "user", "No.")], TURNS))
    assert (found.quotes[0], found.in_reply[0]) == (4, 2)


def test_cues_within_the_one_before_are_not_plain(agrees):
    texts = ["Long is the first one. is the first. And then it is so", "Plain is the one here. And plain is the other. And one is the third"]
    found = agrees("span_swaps", documents=([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS))
    assert set(found.doc_id) == {1}
