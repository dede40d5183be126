"""Collocations against brute force on small texts: nulls, odd separators, languages, ties, repeated rows, one word only, empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm.words import word_checks, word_hashes

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest=5, share=100, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = []
    for lang in n:
        cands = {p: c for (x, p), c in f.items() if x == lang and c >= least and len(p) > 1}
        rows = []
        for p, a in cands.items():
            inside = any(len(q) > len(p) and 100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in cands.items())
            if not inside:
                score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, le, ri, n[lang], s) for i, (s, a, p, le, ri) in enumerate(rows[:first], 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed=4, n=150):
    rng = random.Random(seed)
    bag = ["Ab", "b", "c", "De", "é", "É", "f-g", "日本", "h'", "i"]
    fixed = ["new york city hall", "Ab b c De é f-g i", "of the", "c c c"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 14)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(bag))
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "\r\n", "!", " ;", "\x1c", " "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "en", None, "und", "fr"])))
    return rows + [(n, None, "en"), (n + 1, "", "en"), (n + 2, " ., \n", "xx"), (n + 3, "alone", "yy"), (7, "twin row here", "en"), (7, "twin row here", "en"), (n + 4, "a b " * 3000, "zz")]


@pytest.mark.parametrize("least,longest,share,first", [(3, 5, 100, 2000), (2, 5, 60, 7), (10, 3, 100, 2000)])
def test_equals_brute_force(spark, least, longest, share, first):
    rows = texts()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    frame = frame.withColumns({c: F.lit("x") for c in ("shard", "row", "phrase", "size", "n", "f", "k", "l", "one", "total")})
    got = C.collocations(frame, least, longest, share, first, shard_mb=0.002)
    assert got.schema.simpleString() == "struct<lang:string,rank:bigint,phrase:string,a:bigint,l:bigint,r:bigint,n:bigint,score:bigint>"
    assert found(got) == brute(rows, least, longest, share, first)


def test_empty_and_wordless(spark):
    assert found(C.collocations(spark.createDataFrame([], SCHEMA), 1)) == []
    assert found(C.collocations(spark.createDataFrame([(1, None, None), (2, " . ", "en")], SCHEMA), 1)) == []
    rows = [(1, "one two", None), (2, "one two", "und"), (3, "solo", "en")]
    assert found(C.collocations(spark.createDataFrame(rows, SCHEMA), 1)) == brute(rows, 1)


def test_products_past_64_bits(spark):
    rows = [("en", "", 0, 9 * 10**15), ("en", "a", 1, 8 * 10**15), ("en", "b", 1, 7 * 10**15), ("en", "c", 1, 3), ("en", "a b", 2, 6 * 10**15), ("en", "b c", 2, 3), ("en", "a b c", 3, 3)]
    f = {r[1]: r[3] for r in rows}
    got = {r.phrase: (r.l, r.r, r.score) for r in C.weakest_cut(spark.createDataFrame(rows, "lang string, phrase string, size int, f long")).collect()}
    for phrase in ("a b", "b c", "a b c"):
        w = phrase.split()
        cuts = [(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))]
        score, _, one, two = min((1000 * f[phrase] * f[""] // (f[a] * f[b]), k, f[a], f[b]) for k, (a, b) in enumerate(cuts))
        assert got[phrase] == (one, two, score)


def test_prefix_doubling_orders_suffixes():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 3, 300)
    parted = rng.random(300) < 0.1
    parted[-1] = True
    left = C.words_left(parted)
    key = lambda i: tuple(word[i : i + min(left[i], 8)])
    order = C.suffix_array(word, left, 5)
    assert [key(i) for i in order] == sorted(key(i) for i in range(300))
    shared = C.common_prefixes(word, left, order, 5)
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        x, y = key(a)[:5], key(b)[:5]
        assert n == next((m for m in range(5) if m >= len(x) or m >= len(y) or x[m] != y[m]), 5)


def passes(spark, shards, least, longest=5):
    """What each shard sends in the second pass, with the keys that it was given."""
    tables = [pa.table({"shard": pa.array([i] * len(texts), pa.int32()), "lang": ["en"] * len(texts), "text": texts}) for i, texts in enumerate(shards)]
    rows = [tuple(r.values()) for t in tables for r in C.first_pass(t).to_pylist()]
    given = [tuple(r) for r in C.known_keys(spark.createDataFrame(rows, "shard int, key long, marked long"), least).collect()]
    out = []
    for i, t in enumerate(tables):
        own = [r for r in given if r[0] == i]
        out.append(C.second_pass(t, pa.table({"shard": pa.array([r[0] for r in own], pa.int32()), "key": pa.array([r[1] for r in own], pa.int64()), "total": pa.array([r[2] for r in own], pa.int64())}), longest))
    return given, out


def test_second_pass_sends_words_and_pairs_once_and_a_window_a_place(spark):
    rng = random.Random(2)
    shards = [[" ".join(rng.choice("abc") for _ in range(200)) for _ in range(3)] for _ in range(4)]
    rows = [(0, text, "en") for texts in shards for text in texts]
    _, sent = passes(spark, shards, 2)
    short = [r for t in sent for r in t.to_pylist() if r["size"] in (1, 2)]
    assert len(short) == len({r["phrase"] for r in short}) == 3 + 9
    words = Counter(w for _, text, _ in rows for w in text.split())
    assert {r["phrase"]: r["n"] for r in short if r["size"] == 1} == words
    for texts, t in zip(shards, sent, strict=True):
        places = sum(len(text.split()) - 2 for text in texts)
        windows = [r for r in t.to_pylist() if r["size"] > 2]
        assert sum(r["n"] for r in windows) == places
        assert len(windows) == len({r["phrase"] for r in windows}) <= places
    f = Counter(tuple(w[i : i + m]) for _, text, _ in rows for w in [text.split()] for m in range(1, 6) for i in range(len(w) - m + 1))
    got = C.counted(pa.concat_tables(sent), 2, 5).to_pylist()
    assert {r["phrase"]: r["f"] for r in got if r["size"]} == {" ".join(p): n for p, n in f.items() if n > 1}


def test_keys_whose_checks_differ_are_counted_by_text(spark):
    rows = [(0, 5, 1, 3), (1, 5, 65535, 4), (0, 6, 65535, 3), (1, 6, 65535, 4), (0, 7, 1, 1)]
    keys = spark.createDataFrame([(shard, key, n * 65536 + check) for shard, key, check, n in rows], "shard int, key long, marked long")
    assert sorted(tuple(r) for r in C.known_keys(keys, 2).collect()) == [(0, 5, -1), (0, 6, 7), (1, 5, -1), (1, 6, 0)]
    # words of equal keys: a Thue-Morse word and its complement
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    text = np.frombuffer((one + two).encode(), np.uint8)
    starts, stops = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(word_hashes(text, starts, stops).tolist())) == 1
    assert len(set(word_checks(text, starts, stops).tolist())) == 2
    given, _ = passes(spark, [[f"{one} z q"], [f"{two} z q {two}"]], 2)
    assert -1 in {r[2] for r in given}
    rows = [(i, f"{one if i % 3 else two} z q z {two} z q", "en") for i in range(24)]
    assert found(C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, shard_mb=0.03)) == brute(rows, 3)


def test_first_pass_packs_keys(spark):
    rng = np.random.default_rng(5)
    bag = rng.integers(-(2**63), 2**63, 300)
    shards = [pa.table({"shard": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "marked": pa.array([], pa.int64())})]
    for i in range(3):
        keys = np.unique(rng.choice(bag, 200))
        # a tenth of the keys have checks that differ from shard to shard
        marked = rng.integers(1, 400, len(keys)) * 65536 + keys % 60000 + (keys % 10 == 0) * i
        shards.append(pa.table({"shard": pa.array([i] * len(keys), pa.int32()), "key": keys, "marked": marked}))
    rows = [tuple(r.values()) for t in shards for r in t.to_pylist()]
    sums, checks, owner = Counter(), {}, {}
    for shard, key, marked in rows:
        sums[key] += marked >> 16
        checks.setdefault(key, set()).add(marked & 65535)
        owner.setdefault(key, shard)
    right = sorted((s, k, -1 if len(checks[k]) > 1 else sums[k] if s == owner[k] else 0) for s, k, _ in rows if sums[k] >= 300)
    assert {-1, 0} < {r[2] for r in right}
    for parts in (1, 2, 7, 1000):
        packs = [C.packed(t, parts) for t in shards]
        assert all(len(p) <= parts for p in packs)
        frame = spark.createDataFrame([tuple(r.values()) for p in packs for r in p.to_pylist()], C.PACKED_DDL)
        known = C.known_packed(frame, 300).toArrow()
        found = []
        for i, t in enumerate(shards[1:]):
            own = known.filter(pc.equal(known["shard"], i))
            # a bit a key goes back, however many are frequent
            assert sum(len(x) for x in own["flags"].to_pylist()) <= len(t) / 8 + len(own)
            keys, total = C.answered(t["key"].to_numpy().view(np.uint64), own)
            found += [(i, k, n) for k, n in zip(keys.view(np.int64).tolist(), total.tolist(), strict=True)]
        assert sorted(found) == right


def test_keys_of_the_first_pass_take_ten_bytes():
    rng = np.random.default_rng(6)
    n = 200_000
    keys, marked = rng.integers(-(2**63), 2**63, n), rng.geometric(0.8, n) * 65536 + rng.integers(0, 65536, n)
    packs = C.packed(pa.table({"shard": pa.array(np.zeros(n, np.int32)), "key": keys, "marked": marked}), 50)
    codec = pa.Codec("lz4")
    size = sum(codec.compress(x.as_py()).size for c in ("steps", "marks") for x in packs[c])
    assert size < 10 * n
