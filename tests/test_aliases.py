"""Aliases: donors' names, lookups behind a row's own, hits and the shifts of a case."""

from pyspark.sql import functions as F

from tessera.operators import aliases as A


def test_donor_names_and_hits(spark):
    rows = [(1, "Acute  otitis", ["ear infection", "ACUTE OTITIS", " "], "otitis_media", "an EAR infection", "it is otitis media"), (2, None, None, None, "gout", "gout"), (3, "", [None], "mi", "midline", "an MI, likely"), (4, "Gout", [], None, None, "")]
    frame = spark.createDataFrame(rows, "id int, donor_name string, donor_aliases array<string>, donor_id string, answer string, output string")
    got = {r.id: r for r in A.donor_hits(frame, "answer", "output").collect()}
    assert [got[i].donor_names for i in (1, 2, 3, 4)] == [["Acute otitis", "ear infection", "otitis media"], [], ["mi"], ["Gout"]]
    assert [(got[i].donor_answer_hit, got[i].donor_output_hit) for i in (1, 2, 3, 4)] == [(True, True), (None, None), (False, True), (False, False)]


def test_own_aliases_come_before_those_of_the_table(spark):
    rows = spark.createDataFrame([("a", ["x", "x"]), ("b", []), ("c", None), ("d", None)], "base string, names array<string>")
    known = spark.createDataFrame([("a", ["k"]), ("b", ["k", "m"]), ("c", ["k"])], "base string, aliases array<string>")
    more = spark.createDataFrame([("a", ["m", "x"]), ("b", ["m"]), ("d", ["e"])], "base string, aliases array<string>")
    assert {r.base: r.names for r in A.resolved(rows, "base", "names", known, more).collect()} == {"a": ["x", "m"], "b": ["k", "m"], "c": ["k"], "d": ["e"]}
    assert {r.base: r.names for r in A.resolved(rows, "base", "names", known).collect()} == {"a": ["x"], "b": ["k", "m"], "c": ["k"], "d": []}


def test_shifts(spark):
    rows = [("a", "specific_full_format", True), ("a", "specific_full_specific_cue_1", True), ("b", "specific_full_nonspecific_cue", True), ("b", "specific_full_format", False), ("c", "specific_full_specific_cue_2", True), ("d", "nonspecific_alone_cue", True), ("e", "specific_full_format", None)]
    got = {r.base: r.shift for r in A.shifts(spark.createDataFrame(rows, "base string, variant string, hit boolean"), "base", "variant", "hit").collect()}
    assert got == {"a": "format_shift", "b": "nonspecific_cue_shift", "c": "specific_cue_only", "d": "no_specific_signal", "e": "no_specific_signal"}


def test_hits_of_families(spark):
    frame = spark.createDataFrame([("a rash, then fever", ["rash", "ever"], None), (None, ["rash"], ["x"])], "t string, one_aliases array<string>, two_aliases array<string>")
    got = A.alias_hits(frame, "t", ["one", "two"]).select(F.col("one_hits"), "one_hit", "two_hit").collect()
    assert [tuple(r) for r in got] == [(["rash"], True, False), ([], False, False)]
