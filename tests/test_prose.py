"""Cases of prose and groups of edited spans, against cases worked out by hand and a plain walk over a table."""

import html
import re
import unicodedata

import duckdb
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import prose as P
from tessera.operators.auditing import violations
from tessera.plans import prose as Q
from tessera.plans import texts

SF = "/root/testdata/sf0.001"
TEXT = "A baker of 51 had a dull ache in the left heel. The ache came on after long shifts at the oven, and it faded during rest. Blood counts were normal on both visits. What is the most likely diagnosis?"


def cases(spark, rows, **how):
    frame = spark.createDataFrame(rows, "n long, key string, body string, named string, id string")
    return {r["case_id"]: r for r in P.prose_cases(frame, "body", "named", "n", "key", "mill", **how).collect()}


def test_a_case_of_prose(spark):
    rows = [
        (7, "a", TEXT, " Heel  spur ", "x"), (8, "b", TEXT + " Dull ACHE is common.", "dull  ache", "x"), (9, "c", "Too short a text.", "Gout", None), (10, "d", None, "Gout", ""),
        (11, "e", TEXT, "  ", None), (12, "f", "", "Gout", None), (13, "g", TEXT, None, None),
    ]
    found = cases(spark, rows)
    assert list(found) == ["a"]
    case = found["a"]
    assert case["id"] == "mill_heel_spur_0000007__cues_all" and case["base_id"] == "mill_heel_spur_0000007" and case["diagnosis_id"] == "heel_spur"
    assert case["presentation"] == TEXT.rsplit(" What", 1)[0]
    assert case["cue_targets"] == ["A baker of 51 had a dull ache in the left heel", "The ache came on after long shifts at the oven, and it faded during rest", "Blood counts were normal on both visits"]
    assert case["cue_is_boilerplate"] == [False, False, True] and case["cue_count"] == 3 and case["cue_types"] == ["clinical_span"] * 3
    assert case["presentation"] in case["prompt"] and case["prompt"].endswith('"The answer is <diagnosis>."') and case["prompt"] != case["prompt_cot"]
    assert set(cases(spark, rows, drop_named=False)) == {"a", "b"}
    assert cases(spark, rows, words=(4, 10))["a"]["cue_targets"] == ["The ache came on after long shifts at the oven", "it faded during rest", "Blood counts were normal on both visits"]
    assert cases(spark, rows, most_cues=2, least_cues=2)["a"]["cue_count"] == 2 and cases(spark, []) == {}


def test_gates_of_prose(spark):
    cue = "fever since the weekend"
    rows = [
        (1, f"The man had {cue}.", [cue], "Flu"), (2, f"The man had {cue}. Which diagnosis fits?", [cue], "Flu"), (3, f"Flu or {cue}.", [cue], "flu"), (4, "Nothing is here.", [cue], "Flu"),
        (5, "Nothing is here.", [], "Flu"), (6, "Pain and what the differential was.", ["what the differential was"], "Gout"), (7, "Pain at the knee, Pain at the knee.", ["Pain at the knee", "pain at the knee"], "Gout"),
    ]
    frame = spark.createDataFrame(rows, "id long, body string, cues array<string>, named string")
    found = sorted(map(tuple, violations(frame, "id", P.prose_rules("body", "body", "cues", "named")).collect()))
    assert found == [(2, "reader_question"), (3, "named_label"), (4, "not_verbatim"), (5, "no_cues"), (6, "reader_question"), (7, "duplicate"), (7, "not_verbatim")]
    assert [tuple(r) for r in P.near_constant(frame, "cues").collect()] == [(cue, 4, 4 / 7)] and P.near_constant(frame, "cues", 0.6).collect() == []
    total = P.prose_summary(frame, "body", "cues", "named").collect()[0].asDict()
    assert total == {"n_cases": 7, "cue_occurrences": 7, "distinct_cues": 4, "once_rate": 0.75, "most_common_rate": 0.5714, "formula_rate": 0.0, "named_label": 1, "reader_question": 2}
    none = P.prose_summary(frame.limit(0), "body", "cues", "named").collect()[0]
    assert none["n_cases"] == 0 and none["once_rate"] == 0.0 and none["most_common_rate"] == 0.0


def groups(spark, rows, slots=2):
    frame = spark.createDataFrame(rows, "k string, body string, cues array<string>, other string, prompt string")
    return P.span_groups(P.swap_slots(frame.withColumnRenamed("prompt", "extra"), "k", "body", "cues", slots), "k", "body", "cues", "other").collect()


def test_groups_of_eight(spark):
    body = "At dawn a cough began , then the rash spread, and a limp followed."
    cues = ["a cough began", "the rash spread", "a limp followed", " "]
    rows = groups(spark, [("p", body, cues, "hair fell out", "kept")])
    assert len(rows) == 8 and len({r["id"] for r in rows}) == 8 and {r["extra"] for r in rows} == {"kept"}
    old = rows[0]["cf_original_cue"]
    by = {(r["cf_role"], r["cf_variant"], r["cue_text"]): r["prompt"] for r in rows}
    assert by[P.SWAPPED, "orig", old] == body and by[P.SWAPPED, "swap", "hair fell out"] == body.replace(old, "hair fell out")
    kept = [c for c in cues[:3] if c != old]
    assert {k[2] for k in by if k[0] == P.RETAINED} == set(kept)
    assert all(old not in by[P.RETAINED, "removed", c] and "  " not in by[P.RETAINED, "removed", c] for c in kept)
    assert all(r["cue_text"] in r["prompt"] and r["cue_targets"] == [r["cue_text"]] for r in rows)
    # four cues: two groups
    assert len(groups(spark, [("q", body + " Then sleep was lost.", [*cues[:3], "sleep was lost"], "hair fell out", "")])) == 16
    assert len(groups(spark, [("q", body + " Then sleep was lost.", [*cues[:3], "sleep was lost"], "hair fell out", "")], 1)) == 8


def test_groups_vanish_whole(spark):
    body = "one ache , two aches, three aches"
    assert groups(spark, [("a", body, ["one ache", "two aches"], "x", ""), ("b", body, ["one ache", "two aches", "four aches"], "x", ""), ("c", body, ["two aches", "aches, three", "one ache"], "x", ""), ("d", body, ["one ache", "two aches", "three aches"], None, ""), ("e", None, ["a", "b", "c"], "x", ""), ("f", body, None, "x", ""), ("g", "", ["a", "b", "c"], "x", "")]) == []
    # the removal of "z" joins two spaces that belong to a gold cue: no row of the group is left
    rows = groups(spark, [("h", "p  q z r s", ["p  q", "z", "r s"], "x", ""), ("i", "p q z r s", ["p q", "z", "r s"], "x", "")])
    assert {r["base_id"] for r in rows} == {"i"} and len(rows) == 8


def test_spans_taken_out(spark):
    cut = lambda t, a, b: spark.range(1).select(X.taken_out(F.lit(t), F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))).collect()[0][0]
    assert cut("Had a cough , then slept.", 4, 11) == "Had, then slept."
    assert cut("Slept, ate, ran .", 7, 10) == "Slept,, ran."
    assert cut("all", 0, 3) == ""


def walk(text, label):
    """The rules for one case, word by word."""
    text = unicodedata.normalize("NFKC", text)
    for a, b in zip("’‘“”–—", "''\"\"--"):
        text = text.replace(a, b)
    text = " ".join(text.split())
    if not text or not label or label.lower() in text.lower():
        return None
    cues = clauses_of(text, 4, 25)
    return cues if len(cues) >= 3 else None


def clauses_of(text, least, most):
    parts, start = [], 0
    for i in range(1, len(text) - 1):
        if text[i] == " " and text[i - 1] in ".!?" and (text[i + 1].isdigit() or "A" <= text[i + 1] <= "Z"):
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    whole = []
    for part in parts:
        last = re.split(r"[ (]", whole[-1].lower())[-1].rstrip(".") if whole and whole[-1].endswith(".") else ""
        if last in X.ABBREVIATIONS:
            whole[-1] += " " + part
        else:
            whole.append(part)
    cues = []
    for sentence in whole:
        pieces = [sentence] if len(sentence.split()) <= most else [p.strip(" ,;") for p in re.split(r"; |, (?=(?:and|with|which|who|but) )", sentence)]
        for piece in pieces:
            words = piece.strip().strip(".,;:!? ").split()
            while len(words) > least and words[0].lower().strip(",") in X.CONNECTIVES:
                del words[0]
            cue = " ".join(words)
            if least <= len(words) <= most and cue in text and re.search("[A-Za-z]{3}", cue) and not any(cue.lower() in c.lower() or c.lower() in cue.lower() for c in cues):
                cues.append(cue)
    return cues


def test_cases_of_the_table(spark):
    turns = duckdb.sql(f"SELECT a.conv_id * 1000 + a.turn, a.text, b.text FROM '{SF}/conversations.parquet' a JOIN '{SF}/conversations.parquet' b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'").fetchall()
    want = {}
    for number, text, reply in turns:
        label = re.search(r"[^\W\d_]{3,}", reply or "")
        cues = walk(text or "", label.group() if label else "")
        if cues is not None:
            want[str(number)] = cues
    assert {r["case_id"]: r["cue_targets"] for r in Q.prose_cases(spark, SF).collect()} == want and want


def test_segments_of_the_table(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = {i: clauses_of(" ".join(t.split()), 4, 14) for i, t in items}
    assert {r["item_id"]: r["segments"] for r in texts.sentence_segments(spark, SF).collect()} == want and any(want.values())


def test_titles_of_the_table(spark):
    def title(page):
        found = re.search(r"<title>(.*?)</title>", page or "", re.S | re.I)
        text = unicodedata.normalize("NFKC", html.unescape(found.group(1))) if found else None
        return found and " ".join(text.translate(str.maketrans("’‘“”–—", "''\"\"--")).split())

    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert {r["page_id"]: r["title"] for r in texts.plain_titles(spark, SF).collect()} == {i: title(p) for i, p in pages}
