"""Very long texts and clashing columns for token counts, fingerprints and quality rules."""

import random
import re
from collections import Counter

import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.quality_rules import features, judge
from tessera.llm.simhash import simhash_components
from tessera.llm.token_counts import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = Q.tokenizer("piece_bpe_32k.model")


def long_text(words=150_000):
    rng = random.Random(9)
    bag = ["".join(rng.choice("abcdefg#é") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    return " ".join(rng.choice(bag) + rng.choice(["", "", "\n"]) for _ in range(words))


def test_token_counts_of_long_texts_beside_clashing_columns(spark):
    texts = [long_text(), "short one", None, "x" * 300_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k", "t", "n_bytes", "n_tokens", "over_limit")})
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame, MODEL).collect()}
    for i, text in enumerate(texts):
        n = len(model.encode(text or ""))
        assert got[i] == (len((text or "").encode()), n, n > 4096)


def test_fingerprint_of_a_long_text(spark):
    text = long_text(60_000)
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    frame = spark.createDataFrame([(5, text), (9, text), (7, "else")], "doc_id long, text string").withColumn("fingerprint", F.lit("x"))
    got = {r.doc_id: r for r in simhash_components(frame, shingle=4, distance=4).collect()}
    assert got[5].fingerprint == got[9].fingerprint == f"{want:016x}" and (got[5].component_id, got[9].component_id) == (5, 5)


def test_quality_features_of_a_long_text(spark):
    text = long_text(40_000)
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeats = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    row = judge(features(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("text")).first()
    assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
    assert (row.n_dup_lines, row.n_repeat_words) == (doubled, len(repeats))
