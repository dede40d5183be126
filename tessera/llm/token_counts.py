"""Token counts: byte-pair merging with a heap and a linked list.

A text's symbols are its characters, spaces as the word mark, one mark in front. The pair of neighbours whose join
is a piece of best rank (leftmost among equals) is merged until none is left. Only the count is kept: symbols at
the start less merges, where a character that is no piece counts as its UTF-8 bytes.

Two facts of a vocabulary make words independent, so that each is merged once a worker and its count kept:
no piece holds a word mark after another character, and no piece holds certain pairs of neighbouring characters.
Both are read from the vocabulary; without the first, whole texts are merged.

Defined cases: null and empty texts have no tokens; texts of any length are counted whole; the kept counts are
dropped when they reach ``KEEP`` words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words whose counts a worker keeps, and the longest word kept.
KEEP, KEEP_LENGTH = 600_000, 64


def merges(symbols: str, rank: dict[str, int]) -> int:
    """How many merges ``symbols`` undergo: pop the lowest rank, join it to its right neighbour, look at the new pairs."""
    n = len(symbols)
    if n < 2:
        return 0
    part: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, size = heapq.heappop(heap)
        left = part[i]
        if left is None or (j := after[i]) < 0 or len(left) + len(part[j]) != size:
            continue
        part[i] = joined = left + part[j]
        part[j] = None
        after[i] = k = after[j]
        done += 1
        if k >= 0:
            before[k] = i
            if (r := rank.get(joined + part[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(part[k])))
        if (h := before[i]) >= 0 and (r := rank.get(part[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, size + len(part[h])))
    return done


class Vocabulary:
    """Ranks of a byte-pair vocabulary with byte fallback, and the counts of words met."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # equal scores are one rank, so that the leftmost of them goes first
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {model.id_to_piece(i): order[model.get_score(i)] for i in plain}
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece in self.rank)
        self.pairs = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.words = Words(self)
        self.parts: dict[str, int] = {}

    def count_part(self, part: str) -> int:
        """Tokens of symbols that merge among themselves only."""
        found = self.parts.get(part)
        if found is None:
            found = sum(1 if c in self.rank else len(c.encode()) for c in part) - merges(part, self.rank)
            if len(part) <= KEEP_LENGTH:
                if len(self.parts) >= KEEP:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def count_word(self, word: str) -> int:
        """Tokens of a word with its marks, cut wherever no piece spans two neighbours."""
        total, start, pairs = 0, 0, self.pairs
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                total += self.count_part(word[start:i])
                start = i
        return total + self.count_part(word[start:])

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.by_word:
            return self.count_word(MARK + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = re.findall(" +[^ ]+| +", " " + text)
            return sum(self.words[w[1:]] if w[1:2] not in ("", " ") else self.count_word(w.replace(" ", MARK)) for w in words)
        return sum(map(self.words.__getitem__, text.split(" ")))


class Words(dict):
    """Word without its one leading mark -> tokens."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        found = self.vocabulary.count_word(MARK + word)
        if len(word) <= KEEP_LENGTH:
            if len(self) >= KEEP:
                self.clear()
            self[word] = found
        return found


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, read once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row; rows stay where they are, nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            tokens = pa.array([words.count(x) for x in batch.column(1).to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)], names=["k", "n_bytes", "n_tokens", "over_limit"])

    return (
        docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .mapInArrow(counted, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("k", key)
    )
