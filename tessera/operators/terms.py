"""Terms of a table in texts: one pass a text, whatever the number of terms.

Terms go to the tasks in blocks of at most ``BLOCK`` terms and ``BLOCK_BYTES`` bytes, of which each task builds an automaton; texts are gone through once a block. A term of several words
counts wherever it stands, a single word between signs that are no letters or digits of a-z0-9. Case doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stripped
from tessera.operators.rows import union_all
from tessera.sources.scratch import written

#: Terms, and bytes of them, that a task takes at a time.
BLOCK, BLOCK_BYTES = 200_000, 16_000_000
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

_BUILT: dict[int, tuple[ahocorasick.Automaton, list[str]]] = {}


def _automaton(shared) -> tuple[ahocorasick.Automaton, list[str]]:
    """The automaton of a block's terms, built once a Python worker; only the last is kept."""
    terms = shared.value
    if id(terms) not in _BUILT:  # a broadcast's value is read once a worker
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(term, i)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[id(terms)] = (made, terms)
    return _BUILT[id(terms)]


def found_terms(text: str, automaton: ahocorasick.Automaton, terms: list[str]) -> set[int]:
    """Numbers of the terms that ``text``, in lower case, has."""
    out: set[int] = set()
    for end, i in automaton.iter(text):
        if i in out:
            continue
        term = terms[i]
        start = end - len(term) + 1
        if " " in term or (start == 0 or text[start - 1] not in LETTERS) and (end + 1 == len(text) or text[end + 1] not in LETTERS):
            out.add(i)
    return out


def term_matches(frame: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``key`` and term, in lower case and stripped, of each row of ``frame`` and each term that its text has; null and empty texts and terms match nothing, repeated terms count once."""
    known = written(terms.select(F.lower(stripped(F.col(term))).alias("term")).where("term <> ''").distinct())
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    blocks = max(1, math.ceil(2 * size["n"] / BLOCK), math.ceil(2 * (size["bytes"] or 0) / BLOCK_BYTES)) if size["n"] > BLOCK or (size["bytes"] or 0) > BLOCK_BYTES else 1
    rows = frame.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).where("t IS NOT NULL")
    kind = rows.schema["k"].dataType.simpleString()
    found = []
    for b in range(blocks):
        mine = sorted(r["term"] for r in known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect())  # a block, of a checked size
        if not mine:
            continue
        shared = frame.sparkSession.sparkContext.broadcast(mine)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, names = _automaton(shared)
            for batch in batches:
                hits = [sorted(found_terms(t, automaton, names)) for t in batch.column(1).to_pylist()]
                at = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([names[i] for h in hits for i in h], pa.string())], names=["k", "term"])

        found.append(rows.mapInArrow(work, f"k {kind}, term string"))
    if not found:
        return rows.select(F.col("k").alias(key), F.lit("").alias("term")).limit(0)
    return union_all(found).withColumnRenamed("k", key)
