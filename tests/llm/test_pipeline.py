"""The pipeline's stages, each against brute force on its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import duckdb  # noqa: E402

from tessera.llm.common import stored  # noqa: E402
from tessera.llm.quality_rules import oracle  # noqa: E402
from tests.llm.test_corpus_operators import SF, brute_windows, library, words  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[0].dtypes == steps[4].dtypes


def test_quality(steps):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle()}) WHERE kept").fetchall()}
    assert {r.doc_id for r in steps[1].collect()} == want


def test_near_copies(steps):
    def shingles(t):
        w = words((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    before = {r.doc_id: shingles(r.text) for r in steps[1].collect()}
    after = {r.doc_id for r in steps[2].collect()}
    like = lambda a, b: len(before[a] & before[b]) / len(before[a] | before[b])
    for d in before.keys() - after:
        assert max(like(d, o) for o in before if o != d) > 0.6, "a document without a near copy was dropped"
    kept = sorted(after)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if like(a, b) >= 0.9]


def test_passages(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    want, texts = brute_windows(rows, pipeline.PASSAGE), dict(rows)
    got = {r.doc_id: r for r in steps[3].collect()}
    assert set(got) == {d for d, (n, gone, _) in want.items() if not gone or gone < n}
    for d, r in got.items():
        assert r.text == (want[d][2] if want[d][1] else texts[d]) and r.n_chars == len(r.text)


def test_mixture_and_pieces(steps):
    kept = {r.doc_id for r in steps[3].collect()}
    taken = [r for r in steps[4].collect()]
    assert taken and {r.doc_id for r in taken} <= kept
    rows = {r.doc_id: r for r in steps[5].collect()}
    assert steps[5].count() == len(taken) and all(r.round_trip for r in rows.values())
    for r, want in zip(taken, library([r.text for r in taken]), strict=True):
        assert rows[r.doc_id].ids == want


def test_empty_table(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0
