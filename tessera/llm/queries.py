"""The corpus operators' queries, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.collocations import collocations
from tessera.llm.common import table
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.language_id import held_out, identify, learn
from tessera.llm.mixing import Plan, mix_sources
from tessera.llm.mixing import oracle as mixing_oracle
from tessera.llm.packing import best_fit, token_pieces
from tessera.llm.quality_rules import oracle as quality_oracle
from tessera.llm.quality_rules import features, judge
from tessera.llm.sentencepieces import MARK, encode
from tessera.llm.simhash import simhash_components
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_array_dedup import suffix_array_dedup
from tessera.llm.token_counts import token_counts
from tessera.llm.warc import warc_round_trip

#: Queries by name, and the DuckDB SQL of those that SQL can express.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES["op3_token_counts"] = op3_token_counts


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op8_quality_rules"] = op8_quality_rules
ORACLES["op8_quality_rules"] = quality_oracle()


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_round_trip(table(spark, sf_dir, "pages"), least=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op4_warc"] = op4_warc


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, distance=4)


QUERIES["op2_simhash"] = op2_simhash


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_array_dedup(table(spark, sf_dir, "documents"), length=50)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op10_suffix_array"] = op10_suffix_array


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=20)
    return cleaned.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op1_substring"] = op1_substring


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES["op6_language_id"] = op6_language_id


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES["op9_embedding"] = op9_embedding


#: The production mixture: domains by source, weights, and as many tokens as there are, no document over twice.
MIXTURE = Plan(
    domain_of={f"src{i}": name for name, numbers in (("web", range(10)), ("books", range(10, 14)), ("code", range(14, 17)), ("reference", range(17, 20))) for i in numbers},
    domains={"web": 5, "books": 2, "code": 1, "reference": 2},
    languages={"en": 4, "de": 2, "es": 2, "fr": 2},
    epochs=2,
    share=(1, 1),
)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), MIXTURE).select("row.doc_id", "domain", "n_tokens", "budget", "copies")


QUERIES["op5_mixing"] = op5_mixing
ORACLES["op5_mixing"] = mixing_oracle(MIXTURE)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    shown = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == shown).alias("round_trip"))


QUERIES["op7_sentencepiece"] = op7_sentencepiece


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


QUERIES["op11_hard_negatives"] = op11_hard_negatives
ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, share=100, first=2000)


QUERIES["op12_collocations"] = op12_collocations
ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), total AS (
  SELECT lang, sum(len(words)) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, m, list_slice(words, i, i + m - 1) AS p, count(*) AS f
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m)
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT g.lang, g.p, g.m, g.f AS a, k, le.f AS l, ri.f AS r, n, CAST(1000::HUGEINT * g.f * n // (le.f::HUGEINT * ri.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM grams WHERE m > 1) g
  JOIN grams le ON le.lang = g.lang AND le.p = list_slice(g.p, 1, k) JOIN grams ri ON ri.lang = g.lang AND ri.p = list_slice(g.p, k + 1, g.m)
  JOIN total ON total.lang = g.lang
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), around AS (
  SELECT lang, list_slice(p, i, i + s - 1) AS p, max(f) AS most
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM grams WHERE m > 2)) GROUP BY ALL
)
SELECT w.lang, row_number() OVER o AS rank, array_to_string(w.p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM weakest w LEFT JOIN around u ON u.lang = w.lang AND u.p = w.p WHERE coalesce(100 * u.most < 100 * a, true)
WINDOW o AS (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(array_to_string(w.p, ' ')))
QUALIFY row_number() OVER o <= 2000
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end=0)
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return best_fit(digested, capacity=2048)


QUERIES["op13_packing"] = op13_packing
