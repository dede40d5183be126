"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder, where the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, scratch, stored, table
from tessera.llm.mixing import mixture
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import MIXTURE, tokenizer
from tessera.llm.sentencepieces import encode
from tessera.llm.simhash import similar_groups
from tessera.llm.substring_dedup import substring_dedup

#: Words of a shingle; words of a passage that may stand only once.
SHINGLE, PASSAGE = 5, 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id; rows without doc_id stay, rows of one doc_id are one document."""
    groups = similar_groups(docs, SHINGLE)
    # a doc_id's rows may lie in several groups: it goes if it is the first of none
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    numbered = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return numbered.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier; one of which none are left goes. A text of which nothing goes is unchanged."""
    cleaned = substring_dedup(docs, PASSAGE).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    fresh = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cleaned.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, once an epoch."""
    return mixture(docs, MIXTURE)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, and whether they decode to the text."""
    path = tokenizer("piece_bpe_32k.model")
    coded = encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    shown = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.col("decoded") == shown).alias("round_trip"))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash", drop_near_copies),
    ("substring", drop_repeated_passages),
    ("mixing", mix_to_weights),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():  # what a stage writes on its way goes once its rows are written
            docs = stored(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Merging by rank and hashing by XXH64 aren't SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None
