"""Casts, fallbacks and ratios with one defined answer for missing, empty and odd values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_bool(x: Column) -> Column:
    """true/1/yes/y and false/0/no/n of any case; anything else is null."""
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False)


def wide_bool(x: Column) -> Column:
    """As strict_bool, with t/f, and numbers true unless zero."""
    word = F.lower(F.trim(x.cast("string")))
    number = word.try_cast("double")
    return F.when(word == "t", True).when(word == "f", False).otherwise(F.coalesce(strict_bool(x), number != 0))


def flag(x: Column) -> Column:
    """strict_bool with false for missing."""
    return F.coalesce(strict_bool(x), F.lit(False))


def finite(x: Column) -> Column:
    """A double, or null where there is no finite number."""
    number = x.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def first_said(*texts: Column) -> Column:
    """The first text that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole in doubles, ``empty`` where whole is zero or null."""
    found = F.try_divide(part.cast("double"), whole.cast("double"))
    return found if empty is None else F.coalesce(found, F.lit(empty))


def pick(frame: DataFrame, names: Iterable[str], required: bool = True) -> Column | None:
    """The first of ``names`` that ``frame`` has, case aside."""
    have = {c.lower(): c for c in frame.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    if found is None and required:
        raise ValueError(f"none of {list(names)} among {frame.columns}")
    return None if found is None else F.col(found)


def carry(frame: DataFrame, names: Iterable[str], fill: bool = False) -> list[Column]:
    """Columns of ``names`` that ``frame`` has; with ``fill`` the others as nulls."""
    return [F.col(n) if n in frame.columns else F.lit(None).cast("string").alias(n) for n in names if fill or n in frame.columns]


def prefixed(frame: DataFrame, names: Iterable[str], prefix: str) -> list[Column]:
    return [F.col(n).alias(prefix + n) for n in names if n in frame.columns]


def in_list(x: Column, wanted: Iterable[str]) -> Column:
    """``x`` is one of ``wanted``; "any" or no names let all pass."""
    names = list(wanted)
    return F.lit(True) if not names or "any" in names else x.isin(names)


def checked_range(x: Column, low: float, high: float) -> Column:
    """``x``, or an error where it is no number between the limits."""
    return F.when(x.between(low, high) & ~F.isnan(x), x).otherwise(F.raise_error(F.concat(F.lit("out of range: "), x.cast("string"))))
