"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length are the rows of one matrix and advance together: for each end in turn, all substrings that end there are
hashed from prefix sums, the hashes are looked up among the sorted keys of the pieces, and the best of the pieces found is
kept as a back pointer, for all words at once.

A vocabulary of the unigram kind scores a path by the sum of its pieces' scores. One of the byte-pair kind, for which the
library merges pairs by rank, allows a piece after another only if merging the text of both gives these two again. Then one
path of allowed steps ends at each place, and it is what merging gives; so the maximum is over allowed steps. Which steps are
allowed is found by merging the text of two pieces and remembered. A word for which no path is found (there is none known) is merged.

Characters without a piece become the pieces of their UTF-8 bytes. A text gets one mark in front; spaces and word marks both
are marks, so that decoding gives a word mark back as a space. No piece holds a mark after another character, so words are
searched alone, and a worker remembers those it has met.

Defined cases: null and empty texts have no pieces and are decoded as empty; texts and words of any length are searched whole
(long words are cut where no piece spans two neighbours); other columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import give_back, raw
from tessera.llm.words import ODD, mix

MARK = "▁"
BASE = 0xD1342543DE82EF95
#: Words and ids that a worker remembers, and places for steps (a power of two); the longest word searched without being cut.
KEEP_WORDS, KEEP_IDS, STEPS, LONG = 300_000, 8_000_000, 1 << 21, 48
#: Bits of a filter of the pieces' keys; cells (words by substrings) looked at together; bytes of text laid out at once.
FILTER, CELLS, SLICE = 22, 1 << 19, 2 << 20


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """The symbols that byte-pair merging leaves of ``text``: lowest rank first, leftmost among equals."""
    parts: list[str | None] = list(text)
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))
    waiting = [(r, i, 2) for i in range(len(parts) - 1) if (r := rank.get(text[i : i + 2])) is not None]
    heapq.heapify(waiting)

    def offer(i: int, j: int) -> None:
        both = parts[i] + parts[j]
        if (r := rank.get(both)) is not None:
            heapq.heappush(waiting, (r, i, len(both)))

    while waiting:
        _, i, size = heapq.heappop(waiting)
        j = after[i]
        if parts[i] is None or j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in parts if p is not None]


class Pieces:
    """A vocabulary's pieces, keyed for lookup, and the words and steps met so far."""

    def __init__(self, path: str, additive: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.additive = additive
        self.names = {i: model.id_to_piece(i) for i in plain}
        self.ids = {name: i for i, name in self.names.items()}
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.names[i]: order[model.get_score(i)] for i in plain}
        self.score = np.array([model.get_score(i) for i in range(size)] + [min(map(model.get_score, plain)) - 10.0])
        self.unknown, self.start = size, size + 1
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.pairs = {name[i : i + 2] for name in self.ids for i in range(len(name) - 1)}
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("pieces that span words are not supported")
        # keys of all pieces by size, sorted
        keys, numbers = [], []
        for n in sorted({len(name) for name in self.ids}):
            some = [name for name in self.ids if len(name) == n]
            keys.append(self._keys(self._prefixes(points(some, n)), n, np.array([n]))[:, 0])
            numbers.append(np.array([self.ids[name] for name in some]))
        keys, numbers = np.concatenate(keys), np.concatenate(numbers)
        by = np.argsort(keys)
        self.keys, self.numbers = keys[by], numbers[by].astype(np.int64)
        self.likely = np.zeros(1 << FILTER, bool)
        self.likely[self.keys >> np.uint64(64 - FILTER)] = True
        self._forget()
        self.steps, self.allowed = np.full(STEPS, -1, np.int64), np.zeros(STEPS, bool)
        # what each id adds to a decoded text
        shown = [self.names[i].replace(MARK, " ").encode() if i in self.names else b"" for i in range(size)]
        for b, i in enumerate(self.bytes):
            shown[i] = bytes([b])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    # -- search ------------------------------------------------------------------------------------------------------

    @staticmethod
    def _prefixes(rows: np.ndarray) -> np.ndarray:
        """By word the hashes of its prefixes."""
        out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        letters = mix(rows.astype(np.uint64) + np.uint64(1))
        for i in range(rows.shape[1]):
            out[:, i + 1] = out[:, i] * np.uint64(BASE) + letters[:, i]
        return out

    @staticmethod
    def _keys(prefixes: np.ndarray, end: int, sizes: np.ndarray) -> np.ndarray:
        """Hashes of the substrings of ``sizes`` that end at ``end``."""
        powers = np.array([pow(BASE, int(n), 1 << 64) for n in sizes], np.uint64)
        return mix(prefixes[:, end, None] - prefixes[:, end - sizes] * powers + sizes.astype(np.uint64) * ODD)

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.known, self.known_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 where there is none."""
        out = np.full(keys.shape, -1, np.int64)
        some = self.likely[keys >> np.uint64(64 - FILTER)]
        asked = keys[some]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == asked, self.numbers[at], -1)
        return out

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging the text of both gives both."""
        wanted = [self.names[x] for x in (left, right) if x != self.start]
        return merge("".join(wanted), self.rank) == wanted

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of ids whether the step from one to the other is allowed."""
        left = np.where(left == self.unknown, self.start, left)  # nothing merges with an unknown character
        asked = left * (self.start + 1) + right
        at = (mix(asked.view(np.uint64)) & np.uint64(STEPS - 1)).astype(np.int64)
        out = self.allowed[at]
        new = np.flatnonzero(self.steps[at] != asked)
        if len(new):
            # a step takes the place of another with the same hash
            steps, first, back = np.unique(asked[new], return_index=True, return_inverse=True)
            fresh = np.array([self._stays(*divmod(int(x), self.start + 1)) for x in steps], bool)
            places = at[new][first]
            self.steps[places], self.allowed[places] = steps, fresh
            out[new] = fresh[back]
        return out

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words as rows of code points: by end the best piece that ends there, and where it starts (-1: no path)."""
        n, length = rows.shape
        prefixes = self._prefixes(rows)
        piece = np.full((n, length + 1), -1, np.int64)
        begin = np.full((n, length + 1), -1, np.int64)
        best = np.full((n, length + 1), -np.inf)
        piece[:, 0], best[:, 0] = self.start, 0.0
        for end in range(1, length + 1):
            sizes = np.arange(min(end, self.longest), 0, -1)
            found = self.find(self._keys(prefixes, end, sizes))
            found[:, -1] = np.where(found[:, -1] < 0, self.unknown, found[:, -1])
            came = piece[:, end - sizes]
            good = (found >= 0) & (came >= 0)
            if self.additive:
                value = np.where(good, best[:, end - sizes] + self.score[found], -np.inf)
            else:
                ask = good & (found != self.unknown)
                good[ask] = self.may_follow(came[ask], found[ask])
                value = np.where(good, sizes.astype(np.float64), -np.inf)
            chosen = value.argmax(1)
            row = np.arange(n)
            ok = value[row, chosen] > -np.inf
            piece[ok, end] = found[row, chosen][ok]
            begin[ok, end] = (end - sizes)[chosen][ok]
            best[ok, end] = value[row, chosen][ok]
        return piece, begin

    def spell(self, word: str, pieces: list[int]) -> np.ndarray:
        """Ids with unknown characters as bytes."""
        if self.unknown not in pieces:
            return np.array(pieces, np.int32)
        out, at = [], 0
        for p in pieces:
            if p == self.unknown:
                out += self.bytes[list(word[at].encode())].tolist()
                at += 1
            else:
                out.append(p)
                at += len(self.names[p])
        return np.array(out, np.int32)

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each of ``parts``, which have their marks; those of equal length advance together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        by_length: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            by_length.setdefault(len(part), []).append(i)
        for length, some in by_length.items():
            step = max(1, CELLS // max(1, length * min(length, self.longest)))
            for a in range(0, len(some) if length else 0, step):
                group = some[a : a + step]
                piece, begin = self.search(points([parts[i] for i in group], length))
                # all walk back together, from the last piece to the first
                row, end, path = np.arange(len(group)), np.full(len(group), length), []
                while (end > 0).any():
                    path.append(np.where(end > 0, piece[row, end], -1))
                    end = np.where(end > 0, begin[row, end], end)
                lost, odd = end < 0, np.zeros(len(group), bool)
                forward = np.stack(path[::-1]).T
                odd[:] = (forward == self.unknown).any(1)
                counts = (forward >= 0).sum(1)
                found = np.split(forward[forward >= 0].astype(np.int32), np.cumsum(counts)[:-1])
                for i, ids in zip(group, found, strict=True):
                    out[i] = ids
                for n in np.flatnonzero(odd | lost):
                    i = group[n]
                    ids = [self.ids.get(x, self.unknown) for x in merge(parts[i], self.rank)] if lost[n] else out[i].tolist()
                    out[i] = self.spell(parts[i], ids)
        return out

    def cut(self, word: str) -> list[str]:
        """A long word in parts between which no piece lies."""
        edges = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode_words(self, words: list[str]) -> np.ndarray:
        """Numbers of words, each with its spaces in front, under which ``known_at`` says where ``known`` has their ids."""
        if len(self.words) > KEEP_WORDS or len(self.known) > KEEP_IDS:
            self._forget()
        missing = [w for w in words if w not in self.words]
        if missing:
            marked = [w.replace(" ", MARK) for w in missing]
            parts = [self.cut(w) if len(w) > LONG else [w] for w in marked]
            flat = self.encode_parts([p for x in parts for p in x])
            sizes = np.add.reduceat([len(x) for x in flat], np.cumsum([0, *map(len, parts)])[:-1])
            self.words.update(zip(missing, range(len(self.known_at) - 1, len(self.known_at) - 1 + len(missing)), strict=True))
            self.known = np.concatenate([self.known, *flat])
            self.known_at = np.concatenate([self.known_at, self.known_at[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    # -- whole columns -----------------------------------------------------------------------------------------------

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text of a column."""
        text, ends = raw(pc.replace_substring(column, MARK, " "))
        parts, a = [], 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
            parts.append(self._encode(text[ends[a] : ends[b]], ends[a : b + 1] - ends[a]))
            a = b
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def _encode(self, text: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        sizes = np.diff(ends)
        full = sizes > 0
        # every text that isn't empty gets a space in front
        heads = ends + np.concatenate([[0], np.cumsum(full)])
        flat = np.full(int(heads[-1]), 32, np.uint8)
        flat[np.arange(len(text)) + np.repeat(np.cumsum(full), sizes)] = text
        space = flat == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[heads[:-1][full]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(flat)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]).dictionary_encode()
        number = self.encode_words(words.dictionary.to_pylist())[words.indices.to_numpy()]
        at = self.known_at[number]
        lengths = self.known_at[number + 1] - at
        run = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.known[np.repeat(at - run[:-1], lengths) + np.arange(run[-1])]
        return pa.ListArray.from_arrays(pa.array(run[np.searchsorted(starts, heads)].astype(np.int32)), pa.array(ids))

    def decode(self, column: pa.ListArray) -> pa.Array:
        """Texts of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        ends = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy()
        parts, a = [], 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE // 4, "right")) - 1)
            parts.append(self._decode(ids[ends[a] : ends[b]], ends[a : b + 1] - ends[a]))
            a = b
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        sizes = (self.shown_at[1:] - self.shown_at[:-1])[ids]
        run = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.shown[np.repeat(self.shown_at[ids] - run[:-1], sizes) + np.arange(run[-1])]
        heads = run[ends]
        # the mark that encoding put in front goes
        front = np.flatnonzero(np.diff(heads) > 0)
        front = front[flat[heads[front]] == 32]
        keep = np.ones(len(flat), bool)
        keep[heads[front]] = False
        gone = np.zeros(len(heads), np.int64)
        gone[front + 1] = 1
        flat, heads = flat[keep], heads - np.cumsum(gone)
        texts = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(heads.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode(errors="replace") for x in texts.to_pylist()], pa.string())


def points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


_LOADED: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, additive: bool = False) -> Pieces:
    """The vocabulary, read once a Python worker."""
    if (path, additive) not in _LOADED:
        _LOADED[path, additive] = Pieces(path, additive)
    return _LOADED[path, additive]


def in_slices(batch: pa.RecordBatch, at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text in column ``at``, at least a row each, so that little is held at once on either side."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def encode(frame: DataFrame, path: str, text: str = "text", ids: str = "ids", additive: bool = False, decoded: str | None = None) -> DataFrame:
    """``frame`` with a column ``ids`` of the pieces of ``text``, and with ``decoded`` one of their texts, from the same pass; rows stay where they are. Columns of these names are replaced."""
    frame = frame.drop(ids, *([decoded] if decoded else []))
    at = frame.columns.index(text)
    schema = T.StructType(list(frame.schema.fields)).add(ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path, additive)
        for batch in batches:
            for part in in_slices(batch, at):
                found = known.encode(part.column(at))
                more = [found, known.decode(found)] if decoded else [found]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)
        give_back()

    return frame.mapInArrow(work, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``frame`` with a column ``decoded`` of the texts of ``ids``; a null list gives an empty text. A column of that name is replaced."""
    frame = frame.drop(decoded)
    at = frame.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for batch in batches:
            lists = batch.column(at)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, known.decode(lists)], names=[*batch.schema.names, decoded])

    return frame.mapInArrow(work, T.StructType(list(frame.schema.fields)).add(decoded, T.StringType()))
