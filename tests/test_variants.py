"""Cases of either form, controls, wrappers of prompts and groups held out by name or share."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import prompts
from tessera.operators import splits
from tessera.operators import variants as V


def one(spark, x):
    return spark.range(1).select(x).collect()[0][0]


def test_wrappers(spark):
    ask = lambda mode: one(spark, prompts.asked(F.lit("Why does it itch?"), F.lit(mode)))
    assert ask("raw") == "Why does it itch?"
    assert ask("question") == "Answer the clinical question with the most likely diagnosis or syndrome first.\n\nQuestion: Why does it itch?"
    assert ask("diagnosis_first") == "Answer the clinical question with the most likely diagnosis or syndrome first, in one short sentence. Then give one brief reason.\n\nQuestion: Why does it itch?"
    with pytest.raises(Exception, match="unknown condition"):
        ask("closed")
    option = lambda style: one(spark, prompts.option_surface(F.lit(12), F.lit("Scurvy"), F.lit(style)))
    assert option("number") == "12" and option("number_and_name") == "12. Scurvy"
    with pytest.raises(Exception, match="unknown condition"):
        option("name")


def test_cases_of_either_form(spark):
    three = spark.createDataFrame([("", "b1", "dull ache", "heel spur", "x", "y", "z"), ("i2", "b2", "itch", "dry skin", "p", "q", "r")], "id string, base_id string, nonspecific_target string, specific_expected string, specific_cue_1 string, specific_cue_2 string, specific_cue_3 string")
    got = [r.asDict() for r in V.specificity_cases(three).orderBy("base_id").collect()]
    assert [(r["base_id"], r["specific_targets"], r["diagnostic_shift"]) for r in got] == [("b1", ["x", "y", "z"], "dull_ache_to_heel_spur"), ("i2", ["p", "q", "r"], "itch_to_dry_skin")]
    listed = spark.createDataFrame([(5, "a", "b", ["x"], "own")], "base_id long, nonspecific_target string, specific_expected string, specific_targets array<string>, diagnostic_shift string")
    assert V.specificity_cases(listed).collect()[0].asDict() == {"base_id": "5", "nonspecific_target": "a", "specific_expected": "b", "specific_targets": ["x"], "diagnostic_shift": "own"}
    control = V.control_rows(listed.withColumn("id", F.lit("k")), "shuffled").collect()[0]
    assert (control["control_type"], control["original_id"], control["original_activation_path"]) == ("shuffled", "k", None)


def test_neutral_sentences(spark):
    rows = [("p1", "Has gout. What now?", "Has gout. Owns a cat. What now?", "gout", "cat", "It rains"), ("p2", "Has gout. What now?", "Has gout. Owns a cat. What now?", "gout", "cat", None)]
    pairs = spark.createDataFrame(rows, "id string, original_prompt string, distractor_prompt string, primary_target string, distractor_target string, neutral_sentence string")
    got = {r["id"]: r for r in V.distractor_rows(pairs).collect()}
    assert len(got) == 18 and got["p1__before_neutral_format"]["prompt"] == "It rains. Has gout. What now?" and got["p2__before_neutral_primary"]["prompt"] == V.NEUTRAL + " Has gout. What now?"
    assert {r["base_id"] for r in got.values()} == {"p1", "p2"} and {r["insertion_type"] for r in got.values()} == {"prepend_sentence"}


def test_groups_held_out(spark):
    frame = spark.createDataFrame([(i, f"g{i % 5}") for i in range(60)], "case int, g string")
    held = lambda **how: {r["g"] for r in splits.held_out_groups(frame, "g", "case", "s", **how).where("split = 'heldout'").select("g").distinct().collect()}
    assert held(named=["g1", "g4", "g1"]) == {"g1", "g4"} and len(held(n_held=3)) == 3 and len(held(share=0.5)) == 2
    whole = splits.held_out_groups(frame, "g", "case", "s", named=["g1"])
    assert whole.count() == 60 and whole.where("g = 'g1' AND split <> 'heldout'").isEmpty()
    for wrong in ({"named": ["g9"]}, {"n_held": 5}, {"share": 0.01}, {}):
        with pytest.raises(ValueError, match="group"):
            held(**wrong)
