"""Expressions on small inputs, empty and null ones among them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import cues as C
from tessera.functions import metrics as M
from tessera.functions import text as X
from tessera.functions import values as N
from tessera.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(*words):
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: X.collapse(F.lit("  a  b\n\tc ")), "a b c"),
        (lambda: X.slug(F.lit("--Ab, C!")), "ab_c"),
        (lambda: X.slug(F.lit("?!")), "unknown"),
        (lambda: X.candidate_key(F.lit("Ab/C  d-e")), "ab_c_d-e"),
        (lambda: X.answer_key(F.lit("A_b/ c.")), "a b c"),
        (lambda: X.bare_answer(F.lit(" . The  End.. ")), "the end"),
        (lambda: X.label_key(F.lit(' "Yes" ')), "yes"),
        (lambda: X.item_key(F.lit("- Dry  cough..")), "dry cough"),
        (lambda: X.plain_signs(F.lit("“ﬁne” – it’s")), '"fine" - it\'s'),
        (lambda: X.unescape(F.lit("a &lt;b&gt; &amp; c")), "a <b> & c"),
        (lambda: X.escape(F.lit("<a & b>")), "&lt;a &amp; b&gt;"),
        (lambda: X.has_term(F.lit("Cats sleep"), F.lit("cat")), False),
        (lambda: X.has_term(F.lit("a cat, asleep"), F.lit("CAT")), True),
        (lambda: X.has_term(F.lit("concatenated words"), F.lit("ted wor")), True),
        (lambda: X.has_term(F.lit("c++ (a.b)"), F.lit("a.b")), True),
        (lambda: X.has_term(F.lit("c++ (axb)"), F.lit("a.b")), False),
        (lambda: X.same_answer(F.lit("Gout"), F.lit("acute gout.")), True),
        (lambda: X.same_answer(F.lit("..."), F.lit("gout")), None),
        (lambda: X.same_id(F.lit("a_b"), F.lit("A/B")), True),
        (lambda: X.right_answer(F.lit("the flu"), F.lit("influenza"), texts("flu")), True),
        (lambda: X.right_answer(F.lit(None).cast("string"), F.lit("influenza"), texts("flu")), False),
        (lambda: X.place_in(texts("cold", "the flu", "flu"), F.lit("Flu")), 2),
        (lambda: X.place_in(texts("cold"), F.lit("Flu")), None),
        (lambda: X.stated_answer(F.lit("So the answer is  acute gout. Or not.")), "acute gout"),
        (lambda: X.stated_answer(F.lit("unsure")), None),
        (lambda: X.chosen_option(F.lit("In 2024 I take 2, not 1"), texts("flu", "cold", "gout")), 2),
        (lambda: X.chosen_option(F.lit("It is a cold"), texts("flu", "cold")), 2),
        (lambda: X.chosen_option(F.lit("flu or cold"), texts("flu", "cold")), None),
        (lambda: X.listed_options(F.lit("Q\nOptions:\n1. flu\n2. cold \nend"), "Options:"), ["flu", "cold"]),
        (lambda: X.tag_body(F.lit("x<A> b\nc </a>"), "a"), "b\nc"),
        (lambda: X.tag_body(F.lit("none"), "a"), None),
        (lambda: X.list_items(F.lit("- dry cough; fever,x\n* pain - rash")), ["dry cough", "fever", "pain", "rash"]),
        (lambda: X.distinct_by_case(texts("Ab", "ab", "c")), ["Ab", "c"]),
        (lambda: X.content_tokens(F.lit("The pains are increasing (3) and stools")), ["pain", "increas", "(3)", "stool"]),
        (lambda: X.token_recall(F.lit("the of"), F.lit("x")), None),
        (lambda: X.token_recall(F.lit("sharp pains"), F.lit("a pain")), 0.5),
        (lambda: X.nth_place(F.lit("abABab"), F.lit("ab"), F.lit(2)), 4),
        (lambda: X.nth_place(F.lit("abab"), F.lit("ab"), F.lit(2)), -1),
        (lambda: X.sentences(F.lit("See Dr. Who at 9. Then rest! ok. Yes")), ["See Dr. Who at 9.", "Then rest! ok.", "Yes"]),
        (lambda: X.clean_clause(F.lit(", and with no fever."), 2), "no fever"),
        (lambda: X.clean_clause(F.lit("and with fever"), 2), "with fever"),
        (lambda: X.segments(F.lit("He had a dry cough for days. He had a dry cough. Fever."), 3, 8), ["He had a dry cough for days"]),
        (lambda: X.and_list(texts("a", "b", "c")), "a, b, and c"),
        (lambda: X.and_list(texts("a")), "a"),
        (lambda: X.shortened(F.lit("abcdef"), 5), "ab..."),
        (lambda: X.cut_chain(F.lit("One. Two. Three"), F.lit(0.7)), "One. Two."),
        (lambda: X.cjk_share(F.lit("漢字ab")), 0.5),
        (lambda: X.cjk_share(F.lit("")), 0.0),
        (lambda: X.odd_flags(F.lit("äyou, üV_29 (x)")), []),
        (lambda: X.odd_flags(F.lit("You saw V_29 ( )?")), ["leftover_question_mark", "second_person", "uppercase_code", "empty_parens"]),
        (lambda: X.quotes(F.lit('said "a long quoted part" and “short”')), ["a long quoted part"]),
        (lambda: X.longest_shared_run(F.lit("the sharp chest pain"), F.lit("a sharp chest ache")), 2),
        (lambda: N.strict_bool(F.lit(" YES ")), True),
        (lambda: N.strict_bool(F.lit("2")), None),
        (lambda: N.wide_bool(F.lit("2")), True),
        (lambda: N.wide_bool(F.lit("0.0")), False),
        (lambda: N.finite(F.lit("inf")), None),
        (lambda: N.finite(F.lit("1e3")), 1000.0),
        (lambda: N.first_said(F.lit(" "), F.lit("b")), "b"),
        (lambda: N.ratio(F.lit(1), F.lit(0)), 0.0),
        (lambda: C.entry_list(F.lit("['a', 'b']")), ["a", "b"]),
        (lambda: C.entry_list(F.lit("a; b|c")), ["a", "b|c"]),
        (lambda: C.negation(F.lit("Do you have pain in your chest?")), "does not have pain in their chest"),
        (lambda: C.value_kind(F.lit("V_29")), "opaque"),
        (lambda: C.outermost(texts("pain", "chest pain", "Pain", "fever", "FEVER")), ["chest pain", "fever"]),
    ],
)
def test_expression(spark, column, want):
    assert value(spark, column()) == want


def test_spans_follow_each_other(spark):
    found = value(spark, X.cue_spans(F.lit("pain, chest pain, pain"), texts("pain", "pain", "chest", "none")))
    assert [s and tuple(s) for s in found] == [(0, 4), (12, 16), (6, 11), None]
    assert value(spark, X.overlapping(X.cue_spans(F.lit("abcd"), texts("abc", "bc")))) is True
    span = F.struct(F.lit(6).alias("start"), F.lit(16).alias("end"))
    assert value(spark, X.put_at(F.lit("pain, chest pain, fever"), span, F.lit("rash"))) == "pain, rash, fever"
    assert value(spark, X.cut_at(F.lit("pain, chest pain, fever"), span)) == "pain, fever"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(spark, V.norm(a)) == 5.0
    assert value(spark, V.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, V.norm(V.rescaled(a, F.lit(2.0)))) == pytest.approx(2.0)
    assert sum(value(spark, V.softmax(a))) == pytest.approx(1.0)
    assert value(spark, V.log_softmax(a))[0] == pytest.approx(-1.3132616875)
    assert value(spark, V.sigmoid(F.lit(-1e9))) == pytest.approx(4.248354e-18)
    rows = F.array(a, b, a)
    assert value(spark, V.pooled(rows, F.lit(0), F.lit(2))) == [3.5, 3.5]
    assert value(spark, V.put_rows(rows, F.array(F.lit(1)), F.array(F.array(F.lit(9.0), F.lit(9.0))))) == [[3, 4], [9, 9], [3, 4]]
    offsets = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 0), (0, 3), (3, 7), (7, 9))])
    assert tuple(value(spark, V.token_span(offsets, F.lit(2), F.lit(6)))) == (1, 3)
    ids = F.array(*[F.lit(x) for x in (5, 7, 5, 7, 6)])
    assert value(spark, V.places_of(ids, F.lit(7), right=F.lit(6))) == [3]


def naive_auroc(pairs):
    wins = [(p > n) + (p == n) / 2 for p, n in itertools.product([s for y, s in pairs if y], [s for y, s in pairs if not y])]
    return sum(wins) / len(wins) if wins else None


def test_auroc_and_precision(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.random() < 0.4, float(rng.randrange(6))) for g in "ab" for i in range(60)] + [("c", 1, True, 1.0), ("a", 99, None, 1.0), ("a", 98, True, None)]
    frame = spark.createDataFrame(rows, "g string, i int, label boolean, score double")
    got = {r.g: r for r in M.auroc(frame, ["g"]).collect()}
    known = {g: [(y, s) for h, _, y, s in rows if h == g and y is not None and s is not None] for g in "abc"}
    for g in "ab":
        assert got[g].auroc == pytest.approx(naive_auroc(known[g]), abs=1e-12)
    assert got["c"].auroc is None
    precision = {r.g: r.average_precision for r in M.average_precision(frame, ["g"], "i").collect()}
    for g in "ab":
        ranked = sorted(((-s, i, y) for h, i, y, s in rows if h == g and y is not None and s is not None))
        hits = [sum(y for _, _, y in ranked[: k + 1]) / (k + 1) for k, r in enumerate(ranked) if r[2]]
        assert precision[g] == pytest.approx(sum(hits) / len(hits))


def test_profile_uses_nearest_rank(spark):
    frame = spark.createDataFrame([("a", x) for x in (5, 1, 9, 3, 7)], "g string, v long")
    r = M.profile(frame, ["g"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (r.n, r.least, r.p50, r.p99, r.greatest, r["mean"]) == (5, 1, 5, 9, 9, 5.0)
