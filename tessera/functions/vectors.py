"""Vectors in array columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def directional_error(a: Column, b: Column) -> Column:
    """Mean squared error of the directions, 2 (1 - cosine)."""
    return 2.0 * (1.0 - cosine(a, b))


def rescaled(v: Column, size: Column) -> Column:
    """``v`` at a norm of ``size``."""
    return F.transform(_double(v), lambda x: x * size / F.greatest(norm(v), F.lit(1e-12)))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / total(powers))


def log_softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return F.transform(scores, lambda x: x - top - F.ln(total(F.transform(scores, lambda y: F.exp(y - top)))))


def sigmoid(x: Column) -> Column:
    """With the exponent held between -40 and 40."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def entropy(shares: Column) -> Column:
    return -total(F.transform(shares, lambda p: p * F.ln(F.greatest(p, F.lit(1e-30)))))


def pooled(rows: Column, start: Column, end: Column) -> Column:
    """Mean of the vectors from start to end (half open) of an array of vectors."""
    part = F.slice(rows, start + 1, end - start)
    summed = F.aggregate(F.slice(part, F.lit(2), F.size(part)), F.get(part, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.size(part))


def token_span(offsets: Column, start: Column, end: Column) -> Column:
    """First and last + 1 of the tokens (structs of start, end) that share signs with a span; empty tokens don't count; null if none does."""
    hit = F.filter(F.sequence(F.lit(0), F.size(offsets) - 1), lambda i: (F.get(offsets, i)["start"] < F.get(offsets, i)["end"]) & (F.get(offsets, i)["start"] < end) & (F.get(offsets, i)["end"] > start))
    return F.when(F.size(hit) > 0, F.struct(F.array_min(hit).alias("start"), (F.array_max(hit) + 1).alias("end")))


def places_of(ids: Column, wanted: Column, left: Column | None = None, right: Column | None = None) -> Column:
    """Places (from 0) of an id, with the neighbours asked for."""
    def fits(i: Column) -> Column:
        ok = F.get(ids, i) == wanted
        if left is not None:
            ok = ok & F.coalesce(F.get(ids, i - 1) == left, F.lit(False))
        if right is not None:
            ok = ok & F.coalesce(F.get(ids, i + 1) == right, F.lit(False))
        return ok

    return F.filter(F.sequence(F.lit(0), F.size(ids) - 1), fits)


def put_rows(rows: Column, places: Column, vectors: Column) -> Column:
    """``rows`` with ``vectors`` at ``places``; an error if their counts differ."""
    swapped = F.transform(rows, lambda r, i: F.coalesce(F.get(vectors, F.array_position(places, i).cast("int") - 1), r))
    return F.when(F.size(places) == F.size(vectors), swapped).otherwise(F.raise_error(F.lit("as many vectors as places are needed")))


def unit(v: Column) -> Column:
    """``v`` at length 1, or null where it has none."""
    size = norm(v)
    return F.when(size > 0, F.transform(_double(v), lambda x: x / size))


def random_direction(like: Column, key: Column, seed: int) -> Column:
    """A direction of normally distributed components from hashes of ``key``, with the norm of ``like``."""
    def part(i: Column, k: int) -> Column:
        return (F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1).cast("double") / float((1 << 30) + 1)

    drawn = F.transform(F.sequence(F.lit(1), F.size(like)), lambda i: F.sqrt(-2 * F.ln(part(i, 0))) * F.cos(2 * 3.141592653589793 * part(i, 1)))
    return rescaled(drawn, norm(like))


def logprob_scores(logprobs: Column) -> Column:
    """total, mean and first of a candidate's tokens; null where it has none."""
    sums = F.struct(total(logprobs).alias("total"), (total(logprobs) / F.size(logprobs)).alias("mean"), F.get(logprobs, F.lit(0)).cast("double").alias("first"))
    return F.when(F.size(logprobs) > 0, sums)


def calibrated(scores: Column, baseline: Column) -> Column:
    """Scores less those of the same candidates without the case."""
    return F.zip_with(_double(scores), _double(baseline), lambda a, b: a - b)
