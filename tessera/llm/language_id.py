"""Language identification by a byte convolutional network, trained in numpy on labelled texts.

Bytes are embedded; filters of several widths slide over windows of ``WINDOW`` bytes; each filter's maximum over a window
goes through a rectifier and a dense layer. A text's windows cover all of it; their logits are averaged by bytes and a
softmax gives the language and its score.

To apply it, an embedding and a filter are one table: of two neighbouring bytes, 65,536 rows, so that a filter of four bytes
is two lookups. Windows lie across the inner axis, so that maxima run along memory.

Training: at most about ``SAMPLE`` labelled rows, chosen by a hash of their ids and so spread over all of them, with one
piece of ``PIECE`` characters each from a place that also a hash chooses. Only these are collected. The rest of the work is one
pass over the table without a shuffle.

Defined cases: a null text and one without a letter are ``und`` with score 0; so is every text if nothing is labelled; a null
id is not held out and is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
SAMPLE, PIECE = 6000, 1024
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Every FOLDS-th id by checksum is held out: those of remainder HELD.
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Windows that are looked at together, and bytes of text laid out at once.
TOGETHER, SLICE = 64, 4 << 20


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def windows(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, filled up with zeros; by window its text and how many bytes it has."""
    sizes = np.diff(ends)
    count = np.maximum(-(-sizes // WINDOW), 1)
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    out[np.arange(len(text)) + np.repeat(first * WINDOW - ends[:-1], sizes)] = text
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - first[owner]
    return out.reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - nth * WINDOW, WINDOW)


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Of each window."""
        by_byte = [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        # a filter is tables of byte pairs, and one of single bytes if its width is odd
        tables = [[pair(t[j], t[j + 1]) for j in range(0, len(t) - 1, 2)] + ([t[-1]] if len(t) % 2 else []) for t in by_byte]
        out = np.zeros((len(rows), len(self.labels)), np.float32)
        room = np.empty((WINDOW, TOGETHER, FILTERS), np.float32)
        more = np.empty_like(room)
        for a in range(0, len(rows), TOGETHER):
            b = np.ascontiguousarray(rows[a : a + TOGETHER].T).astype(np.intp)
            pairs = (b[:-1] << 8) | b[1:]
            pooled = []
            for width, t in zip(WIDTHS, tables, strict=True):
                n = WINDOW - width + 1
                total = room[:n, : b.shape[1]]
                for j, table in enumerate(t):
                    at = pairs[2 * j : 2 * j + n] if len(table) > 256 else b[2 * j : 2 * j + n]
                    if j == 0:
                        total = np.take(table, at, axis=0, out=room[:n] if b.shape[1] == TOGETHER else None, mode="clip")
                    else:
                        total += np.take(table, at, axis=0, out=more[:n] if b.shape[1] == TOGETHER else None, mode="clip")
                pooled.append(total.max(axis=0))
            out[a : a + TOGETHER] = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.dense + self.shift
        return out


def train(rows: np.ndarray, wanted: np.ndarray, labels: list[str], seed: int = 17) -> Network:
    """A network for the windows ``rows`` with labels by number; classes count alike. Adam, with gradients at the maxima only."""
    rng = np.random.default_rng(seed)
    n, k = len(WIDTHS) * FILTERS, len(labels)
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n, np.float32),
        rng.normal(0, 1 / np.sqrt(n), (n, k)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    weight = len(wanted) / (k * np.maximum(np.bincount(wanted, minlength=k), 1))
    params = [net.embedding, *net.filters, net.bias, net.dense, net.shift]
    means, squares, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    columns = np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            b = np.ascontiguousarray(rows[pick].T)
            pooled, best = [], []
            for f in net.filters:
                m = WINDOW - len(f) + 1
                total = sum((net.embedding @ f[j])[b[j : j + m]] for j in range(len(f)))
                best.append(total.argmax(axis=0))
                pooled.append(np.take_along_axis(total, best[-1][None], 0)[0])
            h = np.maximum(z := np.concatenate(pooled, axis=1) + net.bias, 0)
            logit = h @ net.dense + net.shift
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), wanted[pick]] -= 1
            d = p * (weight[wanted[pick]] / len(pick))[:, None].astype(np.float32)
            dz = (d @ net.dense.T) * (z > 0)
            grads = [np.zeros_like(net.embedding), *[np.zeros_like(f) for f in net.filters], dz.sum(0), h.T @ d, d.sum(0)]
            for i, f in enumerate(net.filters):
                g = dz[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(f)):
                    by_byte = np.zeros((256, FILTERS), np.float32)
                    np.add.at(by_byte, (b[best[i] + j, np.arange(len(pick))[:, None]], columns[None]), g)
                    grads[1 + i][j] = net.embedding.T @ by_byte
                    grads[0] += by_byte @ f[j].T
            step += 1
            for q, g, m1, m2 in zip(params, grads, means, squares, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network | None:
    """A network from the labelled rows of ``docs`` that aren't held out; none if there are none."""
    known = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    share = min(1.0, SAMPLE / max(1, known.count()))
    spread = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30))
    start = F.pmod(F.xxhash64(F.lit("piece"), F.col(key)), F.greatest(F.length(text) - PIECE, F.lit(1))) + 1
    piece = F.col(text).substr(start.cast("int"), F.lit(PIECE))
    rows = known.where((spread < int(share * (1 << 30))) & (F.length(text) > 0)).select(F.col(key).alias("k"), piece.alias("t"), F.col(label).alias("l")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.k, r.t, r.l))
    labels = sorted({r.l for r in rows})
    data = pa.array([r.t for r in rows], pa.string())
    flat, owner, size = windows(*raw(data))
    full = (size >= WINDOW // 2) | (np.bincount(owner)[owner] == 1)
    wanted = np.array([labels.index(r.l) for r in rows])[owner]
    return train(flat[full], wanted[full], labels)


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def predict(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, owner, size = windows(data, ends)
        total = np.zeros((len(ends) - 1, len(network.labels)))
        np.add.at(total, owner, network.logits(rows) * size[:, None])
        total /= np.maximum(np.diff(ends), 1)[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw(batch.column(1))
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if network is None:
                letters[:] = False
            a = 0
            while a < batch.num_rows and letters.any():
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
                best[a:b], score[a:b] = predict(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                a = b
            names = network.labels if network else [UNKNOWN]
            pred = pa.array([names[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pred, pa.array(np.where(letters, score, 0.0))], names=["k", "lang_pred", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(work, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)
