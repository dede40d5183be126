"""Replacements of cues and the rates over counterfactual rows, against a plain count."""

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import generate as G
from tessera.plans import generation

SF = "/root/testdata/sf0.001"


def test_a_replacement_is_none_of_the_cues(spark):
    vocabulary = ["Ache", "ache", "ACHE", "rash", "Fever", "cough", "limp", None]
    known = {"ache": "ACHE", "rash": "rash", "fever": "Fever", "cough": "cough", "limp": "limp"}
    rows = [(i, [c for k, c in enumerate(["aChe", "RASH", "fever", "cough", "limp", "other"]) if i >> k & 1]) for i in range(64)]
    cases = spark.createDataFrame(rows, "k long, cues array<string>").withColumn("replacement_of", F.lit(1))
    words = spark.createDataFrame([(w,) for w in vocabulary], "replacement string")
    got = {r["k"]: r["replacement"] for r in G.with_replacement(cases, "k", "cues", words).collect()}
    free = {i: {known[w] for w in known} - {known[c.lower()] for c in cues if c.lower() in known} for i, cues in rows}
    assert set(got) == {i for i in free if free[i]} and all(got[i] in free[i] for i in got)
    assert len(set(got.values())) == 5
    assert G.with_replacement(cases, "k", "cues", words.limit(0)).collect() == [] and G.with_replacement(cases.limit(0), "k", "cues", words).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (2, [])], "k long, cues array<string>")
    assert sorted(r["k"] for r in G.with_replacement(odd, "k", "cues", words).collect()) == [1, 2, 2]


def recall(gold, said):
    def tokens(text):
        word, out = "", []
        for c in text.lower() + " ":
            if c in "abcdefghijklmnopqrstuvwxyz0123456789()":
                word += c
            elif word:
                out.append(word)
                word = ""
        cut = set()
        for w in out:
            if w not in X.STOP_WORDS:
                end = next((e for e in ("ing", "ed", "es", "s") if w.endswith(e) and len(w) > 4), "")
                cut.add(w[: len(w) - len(end)])
        return cut

    wanted = tokens(gold)
    return len(wanted & tokens(said)) / len(wanted) if wanted else 0.0


def test_rates_of_the_table(spark):
    rows = generation.counterfactual_rows(spark, SF).collect()
    share = defaultdict(lambda: [0, 0])
    pairs = defaultdict(dict)
    for r in rows:
        reads = lambda cue: recall(cue, r["prompt"]) >= 0.5  # noqa: E731, B023
        if r["role"] == "swapped_slot":
            looks = {"orig": [("orig_reads_original", "original_cue")], "swap": [("swap_reads_replacement", "replacement_cue"), ("swap_still_reads_original", "original_cue")]}[r["variant"]]
        else:
            looks = [(f"retained_{r['variant']}", "gold")] + ([("phantom", "original_cue")] if r["variant"] == "removed" else [])
            pairs[r["doc_id"], r["slot"]][r["variant"]] = reads(r["gold"])
        for name, cue in looks:
            share[name][0] += reads(r[cue])
            share[name][1] += 1
    want = {name: a / b for name, (a, b) in share.items()} | {"pairs": len(pairs)}
    want |= {f"degraded_by_{n}": sum(p["orig"] and not p[v] for p in pairs.values()) / len(pairs) for n, v in (("swap", "swap"), ("removal", "removed"))}
    got = generation.counterfactual_summary(spark, SF).collect()[0].asDict()
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-12 for n in want)
