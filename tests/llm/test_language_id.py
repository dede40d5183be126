"""The language network against a plain convolution and numerical gradients; odd, long and clashing inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as L


def plain_logits(net, window):
    """A window's logits, a filter and a place at a time, in doubles."""
    x = net.embedding.astype(float)[window]
    pooled = []
    for f in net.filters:
        f = f.astype(float)
        places = [np.einsum("we,wef->f", x[i : i + len(f)], f) for i in range(len(x) - len(f) + 1)]
        pooled.append(np.max(places, axis=0))
    return np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.dense.astype(float) + net.shift


def plain_prediction(net, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = np.zeros(len(net.labels))
    for a in range(0, len(data), L.WINDOW):
        part = data[a : a + L.WINDOW]
        total += plain_logits(net, np.append(part, np.zeros(L.WINDOW - len(part), np.uint8))) * len(part)
    total /= len(data)
    p = np.exp(total - total.max())
    p /= p.sum()
    return net.labels[int(p.argmax())], p.max()


@pytest.fixture(scope="module")
def start():
    """A network before its first step."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (12, L.WINDOW)).astype(np.uint8)
    wanted = np.arange(12) % 3
    patch = pytest.MonkeyPatch()
    patch.setattr(L, "EPOCHS", 0)
    net = L.train(rows, wanted, ["aa", "bb", "cc"])
    patch.undo()
    return net, rows, wanted


def test_predictions_equal_a_plain_convolution(spark, start):
    net = start[0]
    rng = np.random.default_rng(3)
    texts = [None, "", " 12 !", "é", "日本語 text", "a" * (L.WINDOW - 1), "ab" * L.WINDOW, "\x00letters\x00", "".join(rng.choice(list("abcxyz éß日,. "), 1500)), "x" + " " * 700, "long and longer " * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(3) for c in ("k", "t", "lang_pred", "score", "lang", "label")}).repartition(3)
    got = {r.doc_id: r for r in L.identify(frame, net).collect()}
    for i, text in enumerate(texts):
        lang, score = plain_prediction(net, text)
        assert got[i].score == pytest.approx(score, abs=1e-5), i
        assert got[i].lang_pred == lang
    assert {r.lang_pred for r in L.identify(frame, None).collect()} == {"und"}


def test_a_very_long_text_is_read_whole(spark, start):
    """Its prediction is the mean over all its windows: the two halves' weighted logits."""
    net = start[0]
    one, two = "first half of it. " * 60_000, "ÇA ALORS, " * 90_000
    frame = spark.createDataFrame([(1, one + two)], "doc_id long, text string")
    data = np.frombuffer((one + two).encode(), np.uint8)
    rows, _, size = L.windows(data, np.array([0, len(data)]))
    total = (net.logits(rows).astype(float) * size[:, None]).sum(0) / len(data)
    p = np.exp(total - total.max())
    got = L.identify(frame, net).first()
    assert got.lang_pred == net.labels[int(total.argmax())] and got.score == pytest.approx(float((p / p.sum()).max()), abs=1e-5)


def test_the_first_step_goes_against_the_numerical_gradient(start, monkeypatch):
    net, rows, wanted = start
    monkeypatch.setattr(L, "EPOCHS", 1)
    monkeypatch.setattr(L, "BATCH", len(rows))
    after = L.train(rows, wanted, net.labels)

    def loss():
        out = 0.0
        for row, label in zip(rows, wanted, strict=True):
            z = plain_logits(net, row)
            out += np.log(np.exp(z - z.max()).sum()) + z.max() - z[label]
        return out / len(rows)  # classes are equally many

    rng = np.random.default_rng(1)
    pairs = [(net.shift, after.shift), (net.bias, after.bias), (net.dense, after.dense), (net.filters[0], after.filters[0]), (net.filters[-1], after.filters[-1]), (net.embedding, after.embedding)]
    checked = 0
    for before, now in pairs:
        for at in rng.choice(before.size, min(before.size, 8), replace=False):
            old, values = before.flat[at], []
            for side in (1e-2, -1e-2):
                before.flat[at] = old + side
                values.append(loss())
            before.flat[at] = old
            slope = (values[0] - values[1]) / 2e-2
            if abs(slope) > 1e-3:  # Adam's first step is a sign
                assert np.sign(now.flat[at] - old) == -np.sign(slope)
                checked += 1
    assert checked >= 10
