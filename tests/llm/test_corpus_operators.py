"""The corpus operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup as E
from tessera.llm import language_id as L
from tessera.llm import mixing as X
from tessera.llm import queries as Q
from tessera.llm import repeats
from tessera.llm import sentencepieces as P
from tessera.llm import simhash as S
from tessera.llm import words as W
from tessera.llm.quality_rules import features, judge, quality_rules
from tessera.llm.simhash import similar_groups, simhash_components
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_array_dedup import suffix_array_dedup
from tessera.llm.token_counts import token_counts
from tessera.llm.warc import warc_round_trip

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = Q.tokenizer("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(t or "")


def corpus(seed=3, n=120):
    """Random texts with shared passages, exact and near copies, odd and empty ones."""
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(bag) for _ in range(k))
    passage, lines = say(70), say(8)
    out = []
    for _ in range(n):
        t = say(rng.randint(0, 90))
        kind = rng.randrange(8)
        if kind == 0:
            t += "\n" + passage + " " + say(5)
        elif kind == 1 and out:
            t = rng.choice(out) or ""
        elif kind == 2 and out:
            w = words(rng.choice(out))
            if len(w) > 30:
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = (lines + "\n") * 4 + t
        out.append(t)
    out += [None, "", " \t\n", "x", "aaaa " * 300, "a" * 700, "ab" * 400, "日本語 テキスト 😀 " * 30, "Ünï cödé\u000b\u000cword", "<s> ▁▁ </s>", " two  spaces ", None, ""]
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(5)


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in ("row", "k", "fp", "ids", "group", "id", "bucket", "kept", "n_words", "decoded", "_domain", "copies", "t")})


# 1 ---------------------------------------------------------------------------------------------------------------------


def brute_windows(rows, length):
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (d, i))
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length, group_mb", [(20, 2), (8, 0.002), (3, 0.004), (300, 0.01), (1, 2)])
def test_substring(docs, texts, length, group_mb):
    got = {r["row"].doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs, length, group_mb=group_mb).collect()}
    assert got == brute_windows(list(enumerate(texts)), length)


def test_substring_of_crowded_passages(spark, monkeypatch):
    """One passage in every text, a third of all ids null; anchors crowded from 20 on."""
    monkeypatch.setattr(repeats, "CROWDED", 20)
    rng = random.Random(8)
    say = lambda k: " ".join(str(rng.randrange(500)) for _ in range(k))
    shared, rows = say(40), []
    for i in range(300):
        rows.append((None if i % 3 == 0 else i, f"own {i} {shared} own {-i}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_windows([(i, t) for i, t in rows if i is not None], 20)
    for mb in (2, 0.002):
        got = substring_dedup(frame, 20, group_mb=mb).collect()
        assert {r["row"].doc_id: (r.n_words, r.n_removed, r.kept) for r in got if r["row"].doc_id is not None} == want
        # null ids come after all others
        assert [r.n_removed for r in got if r["row"].doc_id is None] == [41] * 100  # and the word after it
        kept = suffix_array_dedup(frame, 50, group_mb=mb).where("doc_id IS NULL").select("n_removed").collect()
        assert len(kept) == 100 and all(r.n_removed >= len(shared) for r in kept)


def test_equal_hashes_are_told_apart(monkeypatch):
    text = np.frombuffer(b"aa bb aa cc bb", np.uint8)
    monkeypatch.setattr(W, "word_hashes", lambda text, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(repeats, "word_hashes", W.word_hashes)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    assert W.word_numbers(text, starts, ends).tolist() == [0, 1, 0, 2, 1]
    same = repeats.firsts(text, starts, ends, np.arange(5), np.zeros(5, int))
    assert all(text[starts[i] : ends[i]].tobytes() == text[starts[j] : ends[j]].tobytes() for i, j in enumerate(same))


def test_substring_odd_tables(spark, docs):
    assert substring_dedup(docs.limit(0), 20).count() == 0
    assert substring_dedup(clashing(docs), 20).count() == docs.count()
    long = " ".join(str(i) for i in range(40))
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted((r["row"].doc_id is None, r["row"].doc_id, r.n_removed) for r in substring_dedup(rows, 20).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 40), (True, None, 40)]


# 2 ---------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(t, shingle):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, texts):
    prints = {i: brute_fingerprint(t, 4) for i, t in enumerate(texts)}
    want = components_of(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = by_id(simhash_components(docs))
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (prints[i], want[i]) for i in prints}
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert simhash_components(docs.limit(0)).count() == 0 and simhash_components(clashing(docs)).count() == len(texts)


def test_similar_groups(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    near = [[*b[:90], "changed", *b[91:]] for b in base]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(base + near + base)], "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(similar_groups(rows)).items()} == {i: i % 40 for i in range(120)}
    assert similar_groups(rows.limit(0)).count() == 0


def test_similar_groups_are_those_of_jaccard(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # runs of words: 80 shingles in common of 100 in both, one less, and 80 of 90
    texts = []
    for extra in [10] * 100 + [11] * 60 + [5] * 100:
        common = [word() for _ in range(84)]
        texts += [" ".join(common + [word() for _ in range(extra)]), " ".join([word() for _ in range(20 - min(extra, 10) if extra != 5 else 5)] + common)]
    got = {i: r.component_id for i, r in by_id(similar_groups(frame(texts))).items()}
    joined = [got[2 * i] == got[2 * i + 1] for i in range(260)]
    assert sum(joined[:100]) >= 90 and not any(joined[100:160]) and all(joined[160:])
    assert all(got[i] in (i, i - i % 2) for i in got)
    # boilerplate of two thirds and a line that all have: nothing is a copy
    boiler = " ".join(word() for _ in range(100))
    own = [boiler + " " + " ".join(word() for _ in range(25)) for _ in range(200)]
    got = {i: r.component_id for i, r in by_id(similar_groups(frame(own))).items()}
    assert got == {i: i for i in range(200)}


def test_similar_groups_in_dense_and_crowded_buckets(spark, monkeypatch):
    """Two large groups of near copies with boilerplate in common, and others with it that are no copies: the plan for dense buckets, in blocks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    boiler = [word() for _ in range(60)]
    hubs = [boiler + [word() for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(160):
        w = list(hubs[i % 2])
        w[60 + i // 2 % 60] = word()
        rows.append(" ".join(w))
    rows += [" ".join(boiler + [word() for _ in range(60)]) for _ in range(20)]
    for name, value in (("DENSE", 1), ("SMALL", 8), ("BLOCK", 30), ("CHUNK", 200)):
        monkeypatch.setattr(S, name, value)
    got = {i: r.component_id for i, r in by_id(similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).items()}
    assert got == {i: i % 2 if i < 160 else i for i in range(180)}


def test_odd_sketches_lose_no_pair():
    """Sketches differ in no more bits than the sets in shingles, at every size; at a difference of a ninth of both sizes no pair goes."""
    rng = np.random.default_rng(3)
    for size in (0, 1, 9, 90, 900, 9000):
        for other in (0, 1, size // 10, size):
            common, one, two = (rng.integers(0, 2**64, n, np.uint64) for n in (size, other, size // 10))
            x, y = np.concatenate([common, one]), np.concatenate([common, two])
            bits = [np.frombuffer(S.odd_sketch(h), np.uint64) for h in (x, y)]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(one) + len(two)
            fp = np.stack([np.concatenate([np.zeros(S.WIDE, np.uint64), b]) for b in bits])
            rows = S.Rows(np.zeros(2), np.ones(2, bool), np.arange(2), np.array([len(x), len(y)], np.int32), fp, np.arange(2))
            assert rows.near(0, np.array([1]))[0] or 9 * len(common) < 4 * (len(x) + len(y))
    # at Jaccard 0.7 of 500 shingles a pair is told
    common, one, two = (rng.integers(0, 2**64, n, np.uint64) for n in (412, 88, 88))
    bits = [np.frombuffer(S.odd_sketch(np.concatenate([common, x])), np.uint64) for x in (one, two)]
    assert 9 * np.bitwise_count(bits[0] ^ bits[1]).sum() > 1000


def test_similar_groups_of_odd_rows(spark, docs, texts):
    rows = [(1, None), (2, ""), (None, " "), (3, "a b"), (3, "A  b"), (4, "a c"), (None, "x y z u v w"), (5, "x y z u v w"), (3, "x y z u v w")]
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (4, 4), (5, 3)]
    assert similar_groups(clashing(docs)).count() == len(texts)


# 3, 7 ------------------------------------------------------------------------------------------------------------------


def library(texts):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL).encode([t or "" for t in texts])


def test_token_counts(docs, texts):
    got, want = by_id(token_counts(docs, MODEL, limit=50)), library(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(want[i]), len(want[i]) > 50), t
    assert token_counts(docs.limit(0), MODEL).count() == 0


def test_pieces(docs, texts):
    got, want = by_id(P.decode(P.encode(clashing(docs), MODEL), MODEL)), library(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == want[i]
        assert got[i].decoded == (t or "").replace("▁", " ")
    assert P.decode(P.encode(docs.limit(0), MODEL), MODEL).count() == 0


def test_pieces_on_random_signs():
    import pyarrow as pa

    rng = random.Random(9)
    signs = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x400, 0x460), *range(0x4E00, 0x4E40))]
    some = ["".join(rng.choice(signs if i % 2 else "etaoin shrdlu  ") for _ in range(rng.randint(0, 120))) for i in range(1500)]
    assert P.pieces(MODEL).encode(pa.array(some)).to_pylist() == library(some)


def test_additive_search_is_the_best_path():
    import functools

    known = P.Pieces(MODEL, additive=True)
    for word in ("▁hello", "▁the", "▁unhappyness", "abcabc", "▁日本x"):
        @functools.cache
        def best(n, word=word):
            options = [0.0] if n == 0 else []
            for size in range(1, min(n, known.longest) + 1):
                piece = known.ids.get(word[n - size : n], known.unknown if size == 1 else None)
                if piece is not None:
                    options.append(best(n - size) + known.score[piece])
            return max(options)

        piece, begin = known.search(P.points([word], len(word)))
        total, end = 0.0, len(word)
        while end:
            total, end = total + known.score[piece[0, end]], int(begin[0, end])
        assert total == pytest.approx(best(len(word)))


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, [3 + 0xE2]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert [r.decoded for r in P.decode(rows, MODEL).orderBy("doc_id").collect()] == ["�", "", ""]


# 4 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least):
    rows = [(1, "u1", "abc"), (2, "u2", None), (3, "u\r\nx", "abc"), (4, "u4", ""), (5, None, "é\r\n\r\nWARC/1.1\r\n"), (6, "u6", "é\r\n\r\nWARC/1.1\r\n"), (0, "u0", "xy"), (7, "u7", "xy")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("archive", F.lit(2)).repartition(3)
    got = by_id(warc_round_trip(pages, least), "page_id")
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data]
        first = min(same) if len(data) >= least else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert bytes(r.payload) == (data if first == i else b"")
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_of_repeated_and_long_rows(spark, tmp_path):
    long = "é<p>x</p>\r\n\r\n" * 300_000
    rows = [(1, "u", "abc"), (1, "u", "abc"), (1, "v", "abc"), (None, "u", "xyz"), (None, "w", "xyz"), (None, "u", "abc"), (2, "u", long), (3, "u", long), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc_round_trip(pages, folder=str(tmp_path)).collect()
    count = lambda sha, kind: sorted((r.page_id or 0, r.refers_to or 0) for r in got if r.payload_digest == base64.b32encode(hashlib.sha1(sha.encode()).digest()).decode() and r.record_type == kind)
    assert count("abc", "response") == [(1, 0)] and count("abc", "revisit") == [(0, 1), (1, 1), (1, 1)]
    assert count("xyz", "response") == [(0, 0)] and count("xyz", "revisit") == [(0, 0)]
    assert count(long, "response") == [(2, 0)] and count(long, "revisit") == [(3, 2)]
    assert [bytes(r.payload).decode() == long for r in got if r.page_id == 2] == [True]
    assert list((tmp_path / "records").glob("*.cdx")) and not list((tmp_path / "streams").glob("*.gz"))


def test_warc_query(spark):
    from pyspark.sql import types as T

    got = Q.QUERIES["op4_warc"](spark, SF)
    assert got.schema.simpleString() == "struct<page_id:bigint,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint>"
    assert isinstance(got.schema["refers_to"].dataType, T.LongType)
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = {i: (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if first[x] == i else "revisit", None if first[x] == i else first[x]) for i, x in pages.items()}
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == want


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_mixing_budgets(spark):
    """A domain of one small source can't use its share: its siblings get it before other domains do."""
    plan = X.Plan({"a": "d1", "b": "d1", "c": "d2"}, {"d1": 1, "d2": 1}, {"en": 1}, epochs=1, share=(1, 2))
    rows = [(i, "w " * 10, "en", "a", 0) for i in range(2)] + [(100 + i, "w " * 10, "en", "b", 0) for i in range(50)] + [(200 + i, "w " * 10, None, "c", 0) for i in range(48)] + [(999, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r["row"], r) for r in X.mix_sources(docs, plan).collect()]
    assert len(got) == 100
    budget = {d.source: r.budget for d, r in got}
    assert budget == {"a": 20, "b": 230, "c": 250}
    assert {s: sum(r.copies for d, r in got if d.source == s) for s in "abc"} == {"a": 2, "b": 23, "c": 25}
    taken = X.mixture(clashing(docs), plan)
    assert taken.count() == 50 and set(docs.columns) < set(taken.columns)
    assert X.mix_sources(docs.limit(0), plan).count() == 0
    assert {d.doc_id: r.copies for d, r in got} == {r["row"].doc_id: r.copies for r in X.mix_sources(docs.repartition(9), plan).collect()}


def test_mixing_repeats_epochs(spark):
    plan = X.Plan({}, {"other": 1}, {}, epochs=3, share=(5, 2))
    docs = spark.createDataFrame([(i, "w " * 10, "en", "s", 0) for i in range(10)], DOCS)
    copies = sorted(r.copies for r in X.mix_sources(docs, plan).collect())
    assert copies == [2] * 5 + [3] * 5


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, L.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out("doc_id"))
    assert found.where("lang_pred = lang").count() / found.count() > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !", None), (None, "hello there", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(odd, L.learn(docs.limit(200))).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] != "und"
    assert L.learn(docs.limit(0)) is None and {r.lang_pred for r in L.identify(odd, None).collect()} == {"und"}


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_quality_counts(docs, texts):
    got = by_id(judge(features(docs.select("doc_id", "text"))))
    for i, t in enumerate(texts):
        t, w = t or "", words(t)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        again = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "[#*$%&|<>]"[1:-1] for c in t), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules(docs.limit(0)).count() == 0
    assert set(quality_rules(clashing(docs)).columns) == set(clashing(docs).columns)


# 9 ---------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    hubs = rng.normal(size=(12, 16))
    rows = [(i, (hubs[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.12])).tolist()) for i in range(300)]
    rows += [(500, [x * 1e200 for x in rows[1][1]]), (501, [x * 1e-170 for x in rows[1][1]])]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, []), (2005, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "vec": F.lit(2), "node": F.lit(3)}).repartition(4)
    scaled = {i: np.array(v) / max(map(abs, v)) for i, v in rows if i < 2000}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    ids = list(unit)
    cos = np.stack([unit[i] for i in ids]) @ np.stack([unit[i] for i in ids]).T
    where = {v: k for k, v in enumerate(ids)}
    want = components_of(ids, lambda a, b: cos[where[a], where[b]] >= 0.95)
    got = by_id(E.embedding_dedup(frame), "vec_id")
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int((cos[k] >= 0.95).sum()) - 1, want[i], want[i] == i)
    for i in range(2000, 2006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert E.embedding_dedup(frame.limit(0)).count() == 0


def test_embeddings_of_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.01]), (8, [0.0, 2.0])]
    for kind in ("double", "float"):
        got = E.embedding_dedup(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(5, 1, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 1, 5, False)]
        assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(2, 5)]


def test_crowded_cells_are_dealt_in_blocks(spark, monkeypatch):
    """A cell that holds a group is cut up, and its links are still found."""
    rng, seen = np.random.default_rng(9), []
    base = rng.normal(0, 1, 16)
    rows = [(i, (base + rng.normal(0, 0.01, 16)).tolist()) for i in range(300)] + [(300 + i, rng.normal(0, 1, 16).tolist()) for i in range(50)]
    monkeypatch.setattr(E, "HOMES", 20)
    monkeypatch.setattr(E, "connect", lambda rows, *rest, f=E.connect: seen.append(rows) or f(rows, *rest))
    got = by_id(E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    assert all((got[i].component_id, got[i].n_links) == (0, 299) for i in range(300))
    assert max(r.n for r in seen[0].where("home").groupBy("bucket").agg(F.count("id").alias("n")).collect()) < 60


def test_embedding_recall(spark):
    """All links of the whole small table by brute force: at least 0.9 of them, and none that isn't one."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    true = (m @ m.T >= 0.95).sum(1) - 1
    got = by_id(E.embedding_dedup(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")), "vec_id")
    found = np.array([got[r.vec_id].n_links for r in rows])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()


# 10 --------------------------------------------------------------------------------------------------------------------


def brute_bytes(rows, length):
    first, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length, group_mb", [(50, 2), (20, 0.002), (3, 0.004), (300, 2), (1, 0.004)])
def test_suffix_array(docs, texts, length, group_mb):
    got = {i: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for i, r in by_id(suffix_array_dedup(clashing(docs), length, group_mb=group_mb)).items()}
    assert got == brute_bytes(list(enumerate(texts)), length)
    assert suffix_array_dedup(docs.limit(0), length).count() == 0


# queries ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLES[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, got[order].to_numpy().tolist())) == sorted(map(tuple, want[order].to_numpy().tolist()))


def test_query_columns(spark):
    first = {"op1_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op7_sentencepiece": ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"]}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in first.items():
        frame = Q.QUERIES[name](spark, SF)
        assert frame.columns == columns and frame.count() == docs
    assert Q.QUERIES["op7_sentencepiece"](spark, SF).where("NOT round_trip").count() == 0
