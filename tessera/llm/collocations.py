"""Phrase collocation mining over suffix arrays of word numbers.

Texts are dealt out to shards of about ``SHARD_MB`` MB. A shard's words become numbers, one for each word of a language, and
its suffixes, which end with their piece, are sorted by prefix doubling: ranks by 1, 2, 4 and 8 words. Runs of neighbours that
share a prefix of m words (the intervals of the common-prefix lengths) are the n-grams of m words, and their lengths the counts.

Two passes keep rare n-grams, nearly all of them, out of the shuffles. In the first a shard sends only 64-bit keys of its words and pairs
of words with their counts and a check of 16 bits more, packed in order of the keys, a row for each range of keys; back goes a bit a key,
which tells those that reach the least count over all shards.
In the second each piece is cut wherever a word or a pair is too rare, which no phrase that counts can hold. A word or a pair is
sent as text by one of its shards, with the count over all. Longer n-grams are sent as windows: what is left of the piece from a word on, up to the longest phrase, each
different one once a shard. Windows meet by their first three words, where the counts of all n-grams that begin with these are whole.

If a key's checks differ, its words and pairs are sent as text by each shard and summed up by their text. So keys that collide are told, but for those that agree
in all 80 bits.

A phrase's lowest-scoring cut, its rank, and whether a longer phrase takes it in are joins and sums over the phrases that reach
the least count. Products are exact as decimals of 38 digits.

Defined cases: null and empty texts, and texts of separators only, have no words; a null language is ``und``; a text must fit
into a task's memory some 30 times over; equal rows count as often as they stand there, wherever they are dealt; an empty table gives no rows; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, give_back, raw, stored
from tessera.llm.words import LOWER, cut_out, joined, mix, word_checks, word_hashes, word_numbers

SHARD_MB = 8
#: Parts of a language in which the first phrases are found before those of the whole language.
SALTS = 64
#: Parts of the keys of the first pass, even of few shards, so that no row is large.
LEAST_PARTS = 96
ODD = np.uint64(0x9E3779B97F4A7C15)

#: What parts pieces, and words within them.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = PIECE_ENDS.copy()
GAPS[[0x20, 0x09]] = True


class Shard:
    """The words of a shard's texts: where they stand, a number for each word of a language, its key and check, and the piece."""

    def __init__(self, table: pa.Table):
        text, ends = raw(table.column("text"))
        self.text = LOWER[text]
        inside = ~GAPS[self.text]
        edge = np.zeros(len(text) + 1, bool)
        edge[ends] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        del inside, first, last
        self.langs = table.column("lang").combine_chunks().dictionary_encode()
        if isinstance(self.langs, pa.ChunkedArray):
            self.langs = self.langs.combine_chunks()
        doc = np.searchsorted(ends, self.starts, "right") - 1
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False)[doc]
        # pieces are parted by their ends and by the ends of texts
        edge[:-1] |= PIECE_ENDS[self.text]
        self.piece = np.cumsum(edge[:-1])[self.starts] if len(text) else np.zeros(0, np.int64)
        names, name_ends = raw(pa.array(self.langs.dictionary.to_pylist(), pa.string()))
        lang_keys, lang_checks = word_hashes(names, name_ends[:-1], name_ends[1:]), word_checks(names, name_ends[:-1], name_ends[1:])
        words = word_numbers(self.text, self.starts, self.ends)
        count = int(words.max(initial=-1)) + 1
        _, at, self.word = np.unique(self.lang.astype(np.int64) * count + words, return_index=True, return_inverse=True)
        self.keys = mix(word_hashes(self.text, self.starts[at], self.ends[at]) + mix(lang_keys[self.lang[at]] * ODD))
        self.checks = mix(word_checks(self.text, self.starts[at], self.ends[at]) + mix(lang_checks[self.lang[at]] * ODD))

    def pair_keys(self, at: np.ndarray) -> np.ndarray:
        """Keys of the pairs of words that start at ``at``."""
        return mix(self.keys[self.word[at]] * ODD + self.keys[self.word[at + 1]])

    def pair_checks(self, at: np.ndarray) -> np.ndarray:
        """Checks of the pairs of words that start at ``at``."""
        return mix(self.checks[self.word[at]] * ODD + self.checks[self.word[at + 1]])

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A place of each word and how often it stands there, and the same of each pair of words."""
        left = words_left(np.append(self.piece[1:] != self.piece[:-1], True)[: len(self.piece)])
        order = suffix_array(self.word, left, 2)
        shared = common_prefixes(self.word, left, order, 2)
        return *n_grams(order, shared, left, 1), *n_grams(order, shared, left, 2)


def suffix_array(word: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order of their first ``longest`` words; left: how many words each has to its piece's end."""
    order, rank, h = np.argsort(word, kind="stable"), word + 1, 1
    while h < longest and len(word):
        # ranks by h words, and from h words on, give ranks by 2h words
        after = np.zeros(len(rank), np.int64)
        here = np.flatnonzero(left > h)
        after[here] = rank[here + h]
        both = rank * (int(rank.max()) + 1) + after
        order = np.argsort(both, kind="stable")
        new = np.ones(len(order), np.int64)
        new[1:] = both[order[1:]] != both[order[:-1]]
        rank[order] = np.cumsum(new)
        h *= 2
    return order


def common_prefixes(word: np.ndarray, left: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """Words, up to ``longest``, that each suffix shares with the one before it in ``order``."""
    out = np.zeros(len(order), np.int8)
    a, b, at = order[:-1], order[1:], np.arange(1, len(order))
    for m in range(longest):
        on = (left[a] > m) & (left[b] > m)
        a, b, at = a[on], b[on], at[on]
        on = word[a + m] == word[b + m]
        a, b, at = a[on], b[on], at[on]
        out[at] = m + 1
    return out


def n_grams(order: np.ndarray, shared: np.ndarray, left: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each n-gram of ``m`` words and how often it stands there."""
    heads = np.flatnonzero(shared < m)
    sizes = np.diff(np.append(heads, len(order)))
    whole = left[order[heads]] >= m
    return order[heads[whole]], sizes[whole]


def windows(order: np.ndarray, shared: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each different window, a place's words up to ``longest`` or to its run's end, if three or more: a place, its words and how often it stands there."""
    size = np.minimum(left, longest)[order]
    heads = np.flatnonzero((shared < size) | np.append(True, size[1:] != size[:-1])[: len(size)])
    counts = np.diff(np.append(heads, len(order)))
    long = size[heads] > 2
    return order[heads[long]], size[heads[long]], counts[long]


def words_left(parted: np.ndarray) -> np.ndarray:
    """How many words each word has to the end of its run; parted: whether a run ends after each word."""
    stops = np.flatnonzero(parted)
    return stops[np.searchsorted(stops, np.arange(len(parted)))] - np.arange(len(parted)) + 1


def first_pass(table: pa.Table) -> pa.Table:
    """Keys of a shard's words and pairs of words, and their counts and checks in one number: 65536 times the count, and the check."""
    shard = Shard(table)
    one, n_one, two, n_two = shard.grams()
    keys = np.concatenate([shard.keys[shard.word[one]], shard.pair_keys(two)])
    checks = np.concatenate([shard.checks[shard.word[one]], shard.pair_checks(two)])
    counts = np.concatenate([n_one, n_two])
    give_back()
    number = np.full(len(keys), table.column("shard")[0].as_py(), np.int32)
    marked = counts * 65536 + (checks >> np.uint64(48)).astype(np.int64)
    return pa.table({"shard": pa.array(number), "key": pa.array(keys.view(np.int64)), "marked": pa.array(marked)})


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers, all lowest bytes first, up to the highest that any has: so what hardly differs stands together, which Spark compresses."""
    width = (int(np.bitwise_or.reduce(x.view(np.uint64), initial=0)).bit_length() + 7) // 8
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(found: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers whose ``planes`` were taken."""
    out = np.zeros((n, 8), np.uint8)
    width = len(found) // max(n, 1)
    out[:, :width] = np.frombuffer(found, np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def packed(table: pa.Table, parts: int) -> pa.Table:
    """Of a shard's keys a row for each of ``parts`` equal ranges: how many, the first, the steps from each to the next larger one, and what they are marked with."""
    keys, marked, shard = table.column("key").to_numpy().view(np.uint64), table.column("marked").to_numpy(), table.column("shard").to_numpy()
    sort = np.argsort(keys)
    keys, marked = keys[sort], marked[sort]
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    sizes = np.diff(np.append(heads, len(part)))
    spans = list(zip(heads.tolist(), (heads + sizes).tolist(), strict=True))
    return pa.table(
        {
            "part": part[heads],
            "shard": shard[heads],
            "size": sizes.astype(np.int32),
            "first": keys[heads].view(np.int64),
            "steps": [planes(np.diff(keys[a:b])) for a, b in spans],
            "marks": [planes(marked[a:b]) for a, b in spans],
        },
        schema=PACKED,
    )


def known_in_part(table: pa.Table, least: int) -> pa.Table:
    """What ``known_packed`` gives, of the keys of a part."""
    table = table.sort_by("shard")
    size = table.column("size").to_numpy()
    ends = np.cumsum(size)
    keys, marked = np.zeros(ends[-1], np.uint64), np.zeros(ends[-1], np.int64)
    for i, (first, b, n) in enumerate(zip(table.column("first").to_numpy().view(np.uint64), ends.tolist(), size.tolist(), strict=True)):
        keys[b - n] = first
        keys[b - n + 1 : b] = numbers(table.column("steps")[i].as_py(), n - 1)
        np.cumsum(keys[b - n : b], out=keys[b - n : b])
        marked[b - n : b] = numbers(table.column("marks")[i].as_py(), n).view(np.int64)
    shard, part = table.column("shard").to_numpy(), table.column("part").to_numpy()
    del table
    # of equal keys the first shard comes first
    sort = np.argsort(keys, kind="stable")
    keys = keys[sort]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    del keys
    sums, sizes = np.add.reduceat(marked[sort] >> 16, heads), np.diff(np.append(heads, len(sort)))
    often = sums >= least
    at, sums, sizes = sort[np.repeat(often, sizes)], sums[often], sizes[often]
    del sort
    flags, total = np.zeros(len(marked), bool), np.zeros(len(marked), np.int64)
    if len(at):
        heads = np.cumsum(sizes) - sizes
        check, owner = marked[at] & 65535, np.repeat(shard, size)[at]
        unlike = np.minimum.reduceat(check, heads) != np.maximum.reduceat(check, heads)
        flags[at] = True
        total[at] = np.where(np.repeat(unlike, sizes), -1, np.where(owner == np.repeat(owner[heads], sizes), np.repeat(sums, sizes), 0))
    spans = [slice(b - n, b) for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
    out = {"part": part, "shard": shard, "size": size, "flags": [np.packbits(flags[x]).tobytes() for x in spans], "totals": [planes(total[x][flags[x]]) for x in spans]}
    give_back()
    return pa.table(out, schema=KNOWN)


PACKED = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("size", pa.int32()), ("first", pa.int64()), ("steps", pa.binary()), ("marks", pa.binary())])
KNOWN = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("size", pa.int32()), ("flags", pa.binary()), ("totals", pa.binary())])
PACKED_DDL = "part int, shard int, size int, first long, steps binary, marks binary"


def known_packed(packs: DataFrame, least: int) -> DataFrame:
    """For each row of ``packs`` a bit for each of its keys, which is set if the key stands ``least`` times or more, and the totals of those. So the answer grows with the keys sent, however many are frequent.

    total: the count over all shards in the first shard, 0 in others, -1 in all if the checks differ."""
    return packs.groupBy("part").applyInArrow(lambda table: known_in_part(table, least), "part int, shard int, size int, flags binary, totals binary")


def answered(keys: np.ndarray, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a shard that are frequent, in order, and their totals, by what ``known_packed`` gives for the shard."""
    known = known.sort_by("part")
    flags, total = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for row in known.to_pylist():
        flags.append(np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=row["size"]).astype(bool))
        total.append(numbers(row["totals"], int(flags[-1].sum())).view(np.int64))
    return np.sort(keys)[np.concatenate(flags)], np.concatenate(total)


def known_keys(keys: DataFrame, least: int) -> DataFrame:
    """shard, key and total of the frequent ones among keys that stand a row each, by ``known_packed``."""

    def own(table: pa.Table, known: pa.Table) -> pa.Table:
        found, total = answered(table.column("key").to_numpy().view(np.uint64), known)
        return pa.table({"shard": pa.array(np.full(len(found), table.column("shard")[0].as_py(), np.int32)), "key": found.view(np.int64), "total": total})

    by_shard = keys.groupBy("shard")
    known = known_packed(by_shard.applyInArrow(lambda table: packed(table, 1), PACKED_DDL), least)
    return by_shard.cogroup(known.groupBy("shard")).applyInArrow(own, "shard int, key long, total long")


def second_pass(table: pa.Table, known: pa.Table, longest: int) -> pa.Table:
    """lang, phrase, size and n of the words and pairs that a shard is to send, and of its windows; size 0 has a language's number of words. known: keys and totals, or what ``known_packed`` gives."""
    if not table.num_rows:
        return GRAMS.empty_table()
    shard = Shard(table)
    size = len(shard.word)
    if "flags" in known.column_names:
        one, _, two, _ = shard.grams()
        keys, total = answered(np.concatenate([shard.keys[shard.word[one]], shard.pair_keys(two)]), known)
    else:
        keys = known.column("key").to_numpy().view(np.uint64)
        sort = np.argsort(keys, kind="stable")
        keys, total = keys[sort], known.column("total").to_numpy()[sort]
    out = []
    totals = np.bincount(shard.lang, minlength=len(shard.langs.dictionary)) if size else np.zeros(0, np.int64)
    there = np.flatnonzero(totals)
    out.append((there, pa.array([""] * len(there), pa.string()), np.zeros(len(there), np.int32), totals[there]))
    if size and len(keys):

        def sought(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            return keys[at] == x, total[at]

        often, sums = sought(shard.keys)
        kept = often[shard.word]
        linked = (shard.piece[1:] == shard.piece[:-1]) & kept[1:] & kept[:-1]
        at = np.flatnonzero(linked)
        linked[at], pair_sums = sought(shard.pair_keys(at))
        pair_sum = np.zeros(size, np.int64)
        pair_sum[at] = pair_sums
        flat, places = joined(shard.text, shard.starts, shard.ends)
        runs = np.append(~linked, True)
        alone = runs & np.append(True, runs[:-1])
        # words by number; pairs and windows from the suffixes of runs of two words or more
        counts = np.bincount(shard.word)
        first = np.zeros(len(counts), np.int64)
        first[shard.word[::-1]] = np.arange(size)[::-1]
        one = np.flatnonzero(often & (sums != 0))
        found = [(first[one], np.ones(len(one), np.int64), np.where(sums[one] > 0, sums[one], counts[one]))]
        rest = np.flatnonzero(~alone)
        if len(rest) and longest > 1:
            word, left = shard.word[rest], words_left(runs[rest])
            order = suffix_array(word, left, longest)
            shared = common_prefixes(word, left, order, longest)
            two, n = n_grams(order, shared, left, 2)
            sums = pair_sum[rest[two]]
            sent = sums != 0
            found.append((rest[two[sent]], np.full(int(sent.sum()), 2), np.where(sums > 0, sums, n)[sent]))
            where, m, n = windows(order, shared, left, longest)
            found.append((rest[where], m, n))
        for where, m, n in found:
            starts, stops = places[where], places[where + m] - 1
            out.append((shard.lang[where], slices(flat, starts, stops).cast(pa.string()), m, n))
    give_back()
    return pa.concat_tables(
        pa.table({"lang": shard.langs.dictionary.take(pa.array(lang)), "phrase": phrase, "size": pa.array(m.astype(np.int32)), "n": pa.array(n.astype(np.int64))}, schema=GRAMS) for lang, phrase, m, n in out
    )


def slices(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The slices of ``flat`` as strings."""
    ends = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cut_out(flat, starts, stops).tobytes())])


def counted(table: pa.Table, least: int, longest: int) -> pa.Table:
    """lang, phrase, size and f of what stands ``least`` times or more among words, pairs and windows, of which all that begin alike are in ``table``."""
    lang, size, n = table.column("lang").combine_chunks(), table.column("size").to_numpy(), table.column("n").to_numpy()
    text, ends = raw(table.column("phrase"))
    gaps = np.append(np.flatnonzero(text == 32), len(text))
    gap = np.searchsorted(gaps, ends[:-1])
    out = []
    for m in range(longest + 1):
        # windows of m words or more begin with an n-gram of m words
        at = np.flatnonzero((size >= m) if m > 2 else (size == m))
        stops = np.where(size[at] > m, gaps[np.minimum(gap[at] + max(m - 1, 0), len(gaps) - 1)], ends[at + 1])
        found = pa.table({"lang": lang.take(pa.array(at)), "phrase": slices(text, ends[at], stops), "n": n[at]}).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        often = found.filter(pc.greater_equal(found.column("n_sum"), 0 if m == 0 else least))
        out.append(pa.table({"lang": often.column("lang"), "phrase": often.column("phrase").cast(pa.string()), "size": pa.array(np.full(len(often), m, np.int32)), "f": often.column("n_sum")}))
    give_back()
    return pa.concat_tables(out)


GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def phrase_counts(docs: DataFrame, least: int, longest: int, text: str, lang: Column, shard_mb: float) -> DataFrame:
    """lang, phrase, size and f of all n-grams of 1 to ``longest`` words that stand ``least`` times or more, and of size 0 with a language's number of words."""
    seen = Observation()
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''")
    # written, so that a row's shard holds in both passes, whatever is equal to it
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).observe(seen, F.sum(F.octet_length("text")).alias("n")))
    shards = max(1, math.ceil((seen.get["n"] or 0) / (shard_mb * 1e6)))
    by_shard = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "lang", "text").groupBy("shard")

    # a part has at most about as many keys as a shard, so that tasks are as large for any number of documents
    parts = max(shards, LEAST_PARTS)

    def first(table: pa.Table) -> pa.Table:
        return packed(first_pass(table), parts)

    known = known_packed(by_shard.applyInArrow(first, PACKED_DDL), least)

    def second(table: pa.Table, known: pa.Table) -> pa.Table:
        return second_pass(table, known, longest)

    def whole(table: pa.Table) -> pa.Table:
        return counted(table, least, longest)

    grams = by_shard.cogroup(known.groupBy("shard")).applyInArrow(second, "lang string, phrase string, size int, n long")
    alike = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 3)), F.lit(shards)).cast("int").alias("alike")
    found = stored(grams.select(alike, "lang", "phrase", "size", "n").groupBy("alike").applyInArrow(whole, "lang string, phrase string, size int, f long"))
    dropped(rows)
    return found


def weakest_cut(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, f, l, r, total and score of the phrases of two words or more in ``counts``, by their lowest-scoring cut."""
    phrases = counts.where("size > 1")
    parts = counts.where("size > 0")
    words = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("one", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("two", F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " "))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"])
    cut = cut.join(counts.where("size = 0").select("lang", F.col("f").alias("total")), "lang")
    exact = "1000 * (CAST(f AS DECIMAL(17, 0)) * CAST(total AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    low = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("low")
    return cut.groupBy("lang", "phrase", "size", "f", "total").agg(low).select("lang", "phrase", "size", "f", "low.l", "low.r", "total", "low.score")


def outermost(phrases: DataFrame, counts: DataFrame, share: int) -> DataFrame:
    """``phrases`` without those within a longer phrase of ``counts`` that stands ``share`` hundredths as often or more."""
    words = F.split("phrase", " ")
    sizes = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    inner = counts.where("size > 2").select("lang", "phrase", "size", "f", sizes)
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    return phrases.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around").cast("decimal(20,0)") < share * F.col("f").cast("decimal(20,0)"), F.lit(True))).drop("around")


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    share: int = 100,
    first: int = 2000,
    text: str = "text",
    lang: str = "lang",
    shard_mb: float = SHARD_MB,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` phrases of 2 to ``longest`` words."""
    counts = phrase_counts(docs, least, longest, text, F.col(lang), shard_mb)
    scored = outermost(weakest_cut(counts), counts, share)
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    # a part keeps what may be among the first of all, so that no task orders a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("total").alias("n"), "score")
