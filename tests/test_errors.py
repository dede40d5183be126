"""Signals of wrong answers: disagreement, missing values, rows that have both agreements, tables without labels."""

import pytest

from tessera.operators import errors as E

SCHEMA = "id int, is_error boolean, source_readout_answer_agree boolean, source_probe_answer_agree boolean, source_candidate_entropy_norm double"


def test_signals_leave_out_what_is_missing(spark):
    rows = [(1, True, False, False, 0.9), (2, True, True, None, None), (3, False, True, True, 0.1), (4, False, None, True, 0.95), (5, None, False, False, 0.5)]
    got = {r.signal: r for r in E.signal_report(spark.createDataFrame(rows, SCHEMA), "id", "is_error").collect()}
    assert got.keys() == {"source_readout_disagree", "source_probe_disagree", "source_entropy"}
    readout, entropy = got["source_readout_disagree"], got["source_entropy"]
    assert (readout.n, readout.auroc, readout.tp, readout.fp, readout.tn, readout.fn, readout.precision, readout.recall) == (3, 0.75, 1, 0, 1, 1, 1.0, 0.5)
    assert (entropy.n, entropy.auroc, entropy.tp) == (3, 0.5, None) and entropy.average_precision == pytest.approx(0.5)


def test_paired_rows_have_both_agreements(spark):
    rows = [(1, True, False, True, None), (2, False, True, True, None), (3, True, None, False, None), (4, False, False, None, None), (5, None, True, True, None)]
    got = E.paired_disagreement(spark.createDataFrame(rows, SCHEMA), "id", "is_error").collect()
    assert [tuple(r) for r in got] == [(2, 1.0, 0.5, 0.5)]
    assert E.paired_disagreement(spark.createDataFrame(rows[2:], SCHEMA), "id", "is_error").collect() == []


def test_error_rate_needs_a_label(spark):
    assert tuple(E.error_rate(spark.createDataFrame([(1, True, None, None, None), (2, None, None, None, None)], SCHEMA), "is_error").first()) == (1, 1, 1.0)
    with pytest.raises(Exception, match="no row has a label"):
        E.error_rate(spark.createDataFrame([(2, None, None, None, None)], SCHEMA), "is_error").collect()
