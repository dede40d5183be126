"""Row operators: counts, disjoint splits, pairings, gates, files, streams."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.catalogue import QUERIES
from tessera.operators import auditing, generate, judging, learning, rows, splits
from tessera.sources import files
from tessera.streaming import answers


def test_matched_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        rows.matched(left, right, "k")[0].collect()


def test_donors_come_from_other_groups(spark):
    frame = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, g int")
    found = rows.with_mismatched_donor(frame, "k", "g", "s").collect()
    assert len(found) == 50 and all(r.g != r.donor_g for r in found)
    assert rows.with_mismatched_donor(frame.where("g = 0"), "k", "g", "s").where("donor IS NOT NULL").count() == 0


def test_quota_keeps_full_groups_only(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(10)] + [(99, "c")], "k int, g string")
    assert sorted(r.k for r in rows.quota(frame, "g", ["k"], 3, 1).collect()) == [1, 2, 4]


def test_shards_cover_all_once(spark):
    frame = spark.createDataFrame([(i * 7,) for i in range(5000)], "k long")
    parts = [{r.k for r in rows.shard(frame, "k", 3, i).collect()} for i in range(3)]
    assert [len(p) for p in parts] == [1667, 1667, 1666] and len(set().union(*parts)) == 5000


def test_splits_are_disjoint_and_whole(spark):
    frame = spark.createDataFrame([(c, f"g{c % 4}") for c in range(100) for _ in range(2)], "case int, g string")
    split = splits.stratified(frame, "g", "case", "x")
    assert split.count() == 100 and splits.leaks(split, "case").isEmpty()
    assert {(r.g, r.split): r["count"] for r in split.groupBy("g", "split").count().collect()}[("g0", "train")] == 20
    held = splits.held_out_groups(frame, "g", "case", "x", 1)
    assert held.where("split = 'heldout'").select("g").distinct().count() == 1
    assert splits.stratified(frame, "g", "case", "x").exceptAll(split).isEmpty()


def cases(spark):
    return spark.createDataFrame([("c1", ["dry cough", "high fever", "sharp pain", "red rash"], "blue nails"), ("c2", ["one", "two"], "x")], "base string, cues array<string>, other string")


def test_counterfactual_rows_and_rates(spark):
    made = generate.counterfactual_rows(cases(spark), "base", "cues", "other")
    assert made.count() == 8 and made.select("slot").where("role = 'retained'").distinct().count() == 2
    rates = judging.counterfactual_rates(made.withColumn("observed", F.col("prompt")), "base", "observed", 0.5).first()
    assert (rates.orig_reads_original, rates.swap_reads_replacement, rates.swap_still_reads_original, rates.phantom) == (1.0, 1.0, 0.0, 0.0)
    assert (rates.pairs, rates.degraded_by_swap) == (2, 0.0)


def test_variant_rows(spark):
    made = generate.cue_and_format_rows(cases(spark), "cues", 3).where("base = 'c1'")
    assert [r.variant for r in made.collect()] == ["single_cue", "single_format", "multi_cue_1", "multi_cue_2", "multi_cue_3", "multi_format"]
    assert generate.by_count(cases(spark), "cues", [3, None], F.lit("s")).count() == 3


def test_inserted_sentence(spark):
    one = spark.createDataFrame([("He coughs.", "He coughs. It rains."), ("He coughs.", "It rains. He coughs.")], "a string, b string")
    assert {r.x for r in one.select(generate.inserted_sentence(F.col("a"), F.col("b")).alias("x")).collect()} == {"It rains."}


def test_readout_scoring(spark):
    out = "<readout><assessment>Acute gout</assessment><observed>- swollen toe; fever, red</observed></readout>"
    rows_ = spark.createDataFrame([(1, out, ["gout"], ["swollen toe", "rash"]), (2, None, ["gout"], [])], "id int, o string, a array<string>, c array<string>")
    one, two = judging.scored_readouts(rows_, "o", "a", "c").orderBy("id").collect()
    assert (one.said, one.answer_hit, one.cue_recall, one.cue_precision) == ("Acute gout", True, 0.5, pytest.approx(1 / 3))
    assert (two.answer_hit, two.cue_recall, two.cue_precision) == (False, None, None)


def test_gates(spark):
    frame = spark.createDataFrame([(1, "a, b.", ["a", "b"]), (2, "a.", ["a", "A", "c"]), (3, "x", [])], "id int, prompt string, cues array<string>")
    found = auditing.violations(frame, "id", auditing.cue_rules("cues", "prompt"))
    assert {(r.id, r.rule) for r in found.collect()} == {(2, "duplicate"), (2, "not_verbatim"), (3, "no_cues")}
    with pytest.raises(ValueError):
        auditing.must_pass(found)
    auditing.must_pass(found.where("id = 1"))


def test_logistic_scores_order_the_labels(spark):
    data = [(i, float(i), i % 5, int(i > 50)) for i in range(100)] + [(101, None, 0, 1)]
    frame = spark.createDataFrame(data, "k long, x double, fold int, y int")
    scored = learning.out_of_fold_scores(frame, {"x": ["x"]}, "y", "fold", "k", 5, epochs=200)
    assert scored.count() == 100 and scored.where("(score > 0.5) <> (y = 1)").count() <= 4


def test_shared_runs_and_segments_have_no_cap(spark):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    same = " ".join(f"w{i}" for i in range(40))
    rows += [(60, f"x {same}", f"{same} y"), (61, None, "a"), (62, "", "")]

    def brute(a, b):
        a, b = a.split(), b.split()
        return max([n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if n == 0 or any(a[i : i + n] == b[j : j + n] for j in range(len(b)))], default=0)

    frame = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r.run for r in frame.select("i", X.longest_shared_run(F.col("a"), F.col("b")).alias("run")).collect()}
    assert got == {i: None if a is None else brute(a, b) for i, a, b in rows} and got[60] == 40


def test_replacements_are_of_the_whole_benchmark_and_not_own_cues(spark, tmp_path):
    cues = ["Red", "blue", "Green"]
    spark.createDataFrame([(i, "\n".join(cues)) for i in range(1500)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [f"w{i}" for i in range(60)] + ["red", "RED", "BLUE", "green", "w0"]
    spark.createDataFrame([(i, f"{w}. More") for i, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES["counterfactual_rows"](spark, str(tmp_path)).select("doc_id", "replacement_cue").distinct().collect()
    assert len(found) == 1500 and {r.replacement_cue for r in found} == {f"w{i}" for i in range(60)}


def test_positions_of_all_lines(spark, tmp_path):
    lines = [f"line {i:02}" for i in range(9)] + ["line 03"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["position_rows_all"](spark, str(tmp_path)).orderBy("cue_index").collect()
    assert [(r.start, r.end, r.occurrence) for r in found] == [(8 * i, 8 * i + 7, int(i == 9)) for i in range(10)]


def test_registered_segments_are_whole(spark, tmp_path):
    words = "alpha bravo carbon delta ember forest garden harbor island jungle kettle ladder".split()
    text = " ".join(f"The {w} stands near {w} rivers." for w in words)
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(QUERIES["sentence_segments"](spark, str(tmp_path)).first().segments) == 12


def test_files_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a\tb", None), (2, "c|d", 0.5)], "id int, s string, v double")
    files.write_lines(frame, str(tmp_path / "l"))
    assert sorted(map(tuple, files.read_lines(spark, str(tmp_path / "l"), frame.schema).collect())) == [(1, "a\tb", None), (2, "c|d", 0.5)]
    files.write_split(frame.withColumn("split", F.when(F.col("id") == 1, "train").otherwise("test")), str(tmp_path / "s"))
    assert files.read_split(spark, str(tmp_path / "s"), "train").count() == 1
    files.write_table(frame, str(tmp_path / "t"))
    files.write_tsv(frame, str(tmp_path / "v"))
    (tmp_path / "x.json").write_text('{"rows": [{"id": 1, "s": "x"}, {"id": 2}]}')
    assert files.read_rows(spark, str(tmp_path / "x.json"), "id int, s string").count() == 2
    (tmp_path / "x.csv").write_text('id,s\n1,"a, ""b"""\n')
    assert files.read_rows(spark, str(tmp_path / "x.csv"), "id int, s string").first().s == 'a, "b"'
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{bad\n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "bad.jsonl"), "id int").collect()
    (tmp_path / "k.json").write_text('{"e1": {"question": "q?", "antecedent": true}}')
    assert files.read_keyed(spark, str(tmp_path / "k.json"), "question: string, antecedent: boolean").first().antecedent is True
    assert "c\\|d" in files.markdown(frame) and files.report(frame.agg(F.count("id").alias("n"))) == '{"n": 2}'
    (tmp_path / "vec.bin").write_bytes(b"\x00\x00\x80\x3f\x00\x00\x00\x40")
    assert files.read_vectors(spark, str(tmp_path / "vec.bin")).first().vector == [1.0, 2.0]


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    folder = tmp_path / "in"
    spark.read.parquet(src).where("ts < '2024-01-05'").coalesce(1).write.parquet(str(folder))
    stream = answers.windowed_answers(spark.readStream.schema(schema).parquet(str(folder)), "user_id", "event_type", "ts")
    answers.append_lines(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = answers.windowed_answers(spark.read.parquet(src), "user_id", "event_type", "ts")
    assert got.count() > 0 and got.exceptAll(whole.where("window_start < '2024-01-05'")).isEmpty()
