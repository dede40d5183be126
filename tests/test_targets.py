"""Training targets and answers of chains, by fresh values worked out from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.functions import text as X
from tessera.operators import targets as T

CASE = "id string, diagnosis_name string, diagnosis_aliases array<string>, diagnosis_id string, cue_targets array<string>, target_text string"


def one(spark, row, column):
    return spark.createDataFrame([row], CASE).select(column.alias("x")).first().x


def test_prose_targets(spark):
    args = lambda style, most=6: T.prose_target(F.lit(style), T.label_name(F.col("diagnosis_name"), F.col("diagnosis_aliases"), F.col("diagnosis_id")), F.col("cue_targets"), F.col("target_text"), most)
    row = ("r1", " ", ["Lyme  disease", "x"], "ld", ["tick  bite", "", "tick bite", "ring rash"], "joint pain")
    assert one(spark, row, args("diagnosis_first")) == (
        "<explanation>The activation represents an integrated clinical diagnosis state for Lyme disease. It combines the patient cues, including joint pain, tick bite, tick bite, and ring rash, toward that diagnosis.</explanation>"
    )
    assert one(spark, row, args("cue_then_diagnosis", 2)) == (
        "<explanation>The activation reflects clinical cues such as joint pain, and tick bite. Together, these cues support the most likely diagnosis: Lyme disease.</explanation>"
    )
    bare = ("r2", None, None, "gout", None, None)
    assert "such as the clinical cues in the prompt. Together" in one(spark, bare, args("cue_then_diagnosis")) and "diagnosis: gout." in one(spark, bare, args("cue_then_diagnosis"))
    assert "such as hot toe. Together" in one(spark, ("r3", "Gout", [], "g", ["hot toe"], "hot toe"), args("cue_then_diagnosis"))
    with pytest.raises(Exception, match="unknown target style: rhymed"):
        one(spark, row, args("rhymed"))


def test_structured_rows(spark):
    rows = [("r1", "Tuberculosis <active>", [], "tb", ["night  sweats", "cough & blood", "night sweats"], "weight loss"), ("r2", "", [None], "q", None, None)]
    got = {r.id: r for r in T.training_rows(spark.createDataFrame(rows, CASE), F.lit("val"), 3).collect()}
    assert got["r1"].target_text == (
        "<explanation>\n<readout>\n  <task_type>diagnosis</task_type>\n  <answer>Tuberculosis &lt;active&gt;</answer>\n"
        "  <supporting_cues>weight loss; night sweats; cough &amp; blood</supporting_cues>\n</readout>\n</explanation>"
    )
    assert (got["r1"].base_id, got["r1"].split, got["r1"].target_style, got["r1"].activation_path) == ("r1", "val", "structured_readout_v2_alpha", None)
    assert "<answer></answer>" in got["r2"].target_text and "<supporting_cues>the clinical cues in the prompt<" in got["r2"].target_text


def test_cue_first_targets_are_shuffled_by_row(spark):
    cues = ["Red eye", "red  EYE", " ", "light <hurts>", "tearing", "itch & burn"]
    few = ["Red eye", "light <hurts>", "tearing", "itch & burn"]
    for key in ("row-1", "row-2", "row-3"):
        want = list(few)
        random.Random(f"17:{key}").shuffle(want)
        row = (key, "Keratitis", [], "k", cues, None)
        ordered = T.by_generator(T.different(F.col("cue_targets")), 17, F.col("id"))
        assert one(spark, row, ordered) == want
        shown = "\n".join("- " + c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for c in want[:3])
        assert one(spark, row, T.cue_first_target(ordered, 3, F.col("id"))) == f"<explanation>\n<readout>\n<observed>\n{shown}\n</observed>\n</readout>\n</explanation>"
        assert "</observed>\n<assessment>Findings most consistent with Keratitis.</assessment>\n</readout>" in one(spark, row, T.cue_first_target(ordered, 3, F.col("id"), F.col("diagnosis_name")))
        assert "<assessment>Findings are non-specific.</assessment>" in one(spark, row, T.cue_first_target(ordered, 3, F.col("id"), F.lit(None)))
    with pytest.raises(Exception, match="no cues in row empty"):
        one(spark, ("empty", "K", [], "k", [""], None), T.cue_first_target(T.by_hash(T.different(F.col("cue_targets")), 17, F.col("id")), 3, F.col("id")))


def test_cut_chain(spark):
    cases = [("Pain. Fever now", 1.0, "Pain. Fever now"), ("Dose was 2.5 then more words", 0.5, "Dose was 2.5 t"), ("One. Two! Three? Four", 0.75, "One. Two!"), ("One.\nTwo and so on", 0.5, "One."), (". a b c d", 0.5, ". a"), ("abc def", 0.6, "abc"), (None, 0.5, ""), ("all", 0.0, "")]
    frame = spark.createDataFrame(cases, "t string, s double, want string")
    assert [(r.want, r.got) for r in frame.select("want", X.cut_chain(F.col("t"), F.col("s")).alias("got")).collect()] == [(w, w) for _, _, w in cases]
    with pytest.raises(Exception, match="between 0 and 1"):
        frame.select(X.cut_chain(F.col("t"), F.lit(1.5))).collect()


def test_stated_answer(spark):
    cases = [("So. The answer is gout.", "gout"), ("THE ANSWER IS gout.", None), ("The answer is: gout", None), ("The answer is : gout", ": gout"), ("The answer is gout\nmore", None), ("the answer\n is  acute   gout \n", "acute gout"), ("The answer is 3.5 mg", "3"), ("", None), (None, None)]
    frame = spark.createDataFrame(cases, "t string, want string")
    assert [r.got for r in frame.select(X.stated_answer(F.col("t")).alias("got")).collect()] == [w for _, w in cases]


def test_prose_presentations_are_stripped_of_all_white_space(spark):
    got = spark.createDataFrame([("\n\t A fall. \n",)], "t string").select(P.as_written(F.col("t")).alias("x")).first().x
    assert got.endswith("as follows:\n\nA fall.")
