"""Tables of patients: entries in use, rows that can't be read, and what a table looks like."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.cues import entry_list
from tessera.functions.values import first_said

#: Columns that hold entries, in order of preference; the first two are those of tables of cases.
COLUMNS = ("EVIDENCES", "evidences")
LOOKED_FOR = ("evidences", "evidence", "symptoms")


def read_patients(spark: SparkSession, paths: str | list[str], line_ends: bool = True) -> DataFrame:
    """Rows of CSV files with a header, all columns as text, fields of any length.

    With ``line_ends`` a field may hold line ends, and each file is read by one task; without, files are split. Names that differ in case only
    are kept as they are. Write many files of some 100 MB, or say that there are no line ends.
    """
    return spark.read.csv(paths, header=True, quote='"', escape='"', multiLine=line_ends, maxCharsPerColumn=-1, nullValue=None, emptyValue="")


@F.pandas_udf(ArrayType(StringType()))
def _items(x: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str] | None:
        try:
            return None if text is None else [str(v) for v in ast.literal_eval(text)]
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return None

    return x.map(one).astype(object)


def entry_lists(patients: DataFrame) -> DataFrame:
    """raw, items: the first of the entry columns that says something, as a literal list; no items for an empty one, null for one that can't be read."""
    places = {c: i for i, c in enumerate(patients.columns)}
    have = [f"_c{places[c]}" for c in COLUMNS if c in places]
    if not have:
        raise ValueError(f"none of {COLUMNS} among {patients.columns}")
    plain = patients.toDF(*[f"_c{i}" for i in range(len(patients.columns))])
    raw = plain.select(F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in have], F.lit("")).alias("raw"))
    return raw.select("raw", F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(_items(F.when(F.col("raw") != "", F.col("raw")))).alias("items"))


def entries_in_use(patients: DataFrame) -> DataFrame:
    """entry: each entry that a patient has, once; rows that can't be read are left out. Equal entries go in each task before they are sent."""
    return entry_lists(patients).select(F.explode("items").alias("entry")).distinct()


def reading(patients: DataFrame) -> DataFrame:
    """One row: n_rows, unreadable (rows whose list can't be read), empty, n_items."""
    return entry_lists(patients).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("items").isNull()).alias("unreadable"), F.count_if(F.size("items") == 0).alias("empty"), F.coalesce(F.sum(F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long")), F.lit(0)).alias("n_items")
    )


def entry_column(frame: DataFrame) -> str | None:
    """The column that holds entries by its name, case aside."""
    lower = {c.lower(): c for c in frame.columns}
    return next((lower[n] for n in LOOKED_FOR if n in lower), None)


def first_entries(frame: DataFrame, most: int = 20) -> DataFrame:
    """``frame`` with n_entries and the first ``most`` of each row, read as lists of any kind: for a look at a table."""
    name = entry_column(frame)
    if name is None:
        raise ValueError(f"none of {LOOKED_FOR} among {frame.columns}")
    items: Column = entry_list(first_said(F.col(f"`{name}`"), F.lit("")))
    return frame.withColumn("_items", items).withColumns({"n_entries": F.size("_items"), "first_entries": F.slice("_items", 1, most)}).drop("_items")
