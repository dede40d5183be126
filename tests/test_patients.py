"""Tables of patients as files."""

import csv

import pytest

from tessera.sources import patients as P


def written(path, header, rows):
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


def test_entries_of_files(spark, tmp_path):
    long = "x" * 300_000
    rows = [
        ("1", "['a_@_b', 'c']"), ("2", f"['{long}', 'c']"), ("3", "['line\\nend',\n\"it's, so\"]"), ("4", "not a list"), ("5", ""), ("6", "['a_@_b'"), ("7", "{'k': False}"), ("8", "('t', 3)"), ("9", "7"), ("1", "['a_@_b', 'c']"), ("10", "['é\"q']"),
    ]
    table = P.read_patients(spark, written(tmp_path / "p.csv", ["ID", "EVIDENCES"], rows))
    assert table.count() == 11
    assert {r["entry"] for r in P.entries_in_use(table).collect()} == {"a_@_b", "c", long, "line\nend", "it's, so", "k", "t", "3", 'é"q'}
    assert P.reading(table).collect()[0].asDict() == {"n_rows": 11, "unreadable": 3, "empty": 1, "n_items": 12}
    flat = P.read_patients(spark, written(tmp_path / "q.csv", ["evidences", "x"], [("['a']", "1"), ("", "2")]), line_ends=False)
    assert [r["entry"] for r in P.entries_in_use(flat).collect()] == ["a"]
    assert P.entries_in_use(table.limit(0)).collect() == [] and P.reading(table.limit(0)).collect()[0]["n_items"] == 0
    with pytest.raises(ValueError, match="EVIDENCES"):
        P.entries_in_use(table.select("ID"))


def test_either_column_and_a_look(spark):
    both = spark.createDataFrame([("['a']", None), ("", "['b']"), (None, "['c']"), (None, None)], "EVIDENCES string, other string").toDF("EVIDENCES", "evidences")
    assert {r["entry"] for r in P.entries_in_use(both).collect()} == {"a", "b", "c"}
    looked = spark.createDataFrame([(1, "a; b;c"), (2, '["x", "y"]'), (3, None), (4, " ")], "raw long, Symptoms string")
    assert [(r["n_entries"], r["first_entries"]) for r in P.first_entries(looked, 2).orderBy("raw").collect()] == [(3, ["a", "b"]), (2, ["x", "y"]), (0, []), (0, [])]
    assert P.entry_column(looked) == "Symptoms" and P.entry_column(looked.select("raw")) is None
