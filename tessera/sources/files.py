"""Readers and writers of the row formats: line JSON, JSON documents, CSV, vectors, split folders; Parquet, TSV, reports."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Line JSON of one or more paths; a bad line fails the read, or with ``strict`` off gives nulls. Blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType, under: tuple[str, ...] = ("data", "rows", "patients")) -> DataFrame:
    """Rows of .jsonl, of a .json list or object that holds one under a known name, or of a CSV with a header."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if path.endswith(".jsonl"):
        return read_lines(spark, path, kind)
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        rows = T.ArrayType(kind)
        bare = F.from_json("value", rows)
        held = F.from_json("value", T.StructType([T.StructField(n, rows) for n in under]))
        found = F.when(F.col("value").rlike(r"^\s*\["), bare).otherwise(F.coalesce(*[held[n] for n in under]))
        return whole.select(F.explode(found).alias("r")).select("r.*")
    return spark.read.csv(path, schema=kind, header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, enforceSchema=False)


def read_keyed(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and the fields of ``value`` of a JSON object by key: a dimension table."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("key", "v")).select("key", "v.*")


def read_vectors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, vector of files of little-endian 32-bit floats."""
    @F.pandas_udf("array<float>")
    def floats(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, "<f4").tolist())

    return spark.read.format("binaryFile").load(paths).select("path", floats("content").alias("vector"))


def checked_vector(v: Column, size: int) -> Column:
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.concat(F.lit("not a vector of the size: "), F.size(v).cast("string"))))


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """Rows of a folder written by split; one split reads its own files only."""
    rows = spark.read.parquet(folder)
    return rows if split is None else rows.where(F.col("split") == split)


def write_split(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(folder)


def write_lines(rows: DataFrame, folder: str, append: bool = False) -> None:
    """Line JSON, keys sorted, nulls written."""
    rows.select(sorted(rows.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(folder)


def append_new(rows: DataFrame, folder: str, key: str) -> None:
    """Append, as line JSON, the rows whose ``key`` the folder doesn't hold, one for each key; so a run that ended half-way, or one that is repeated, leaves each key once.

    What is there stays as it is, a null key is a key, and only keys are read of what is there. Two runs at the same time may both write a key.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        there = spark.read.schema(T.StructType([rows.schema[key]])).json(folder).select(F.col(key).alias("_there"))
        fresh = fresh.join(there.distinct(), F.col(key).eqNullSafe(F.col("_there")), "left_anti")
    write_lines(fresh, folder, append=True)


def write_table(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def write_tsv(rows: DataFrame, folder: str) -> None:
    flat = [F.regexp_replace(f.name, r"\s+", " ").alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(folder)


def markdown(summary: DataFrame, most: int = 200) -> str:
    """A pipe table of a summary's first rows; pipes and line ends in cells are masked."""
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [" | ".join(summary.columns), " | ".join("---" for _ in summary.columns)]
    lines += [" | ".join(show(v) for v in row) for row in summary.limit(most).collect()]
    return "\n".join(f"| {x} |" for x in lines)


def report(summary: DataFrame) -> str:
    """JSON of a one-row summary."""
    return json.dumps(summary.first().asDict(recursive=True), sort_keys=True, ensure_ascii=False, default=str)


def card(rows: DataFrame, lists: tuple[str, ...], sample: int = 2000) -> DataFrame:
    """n_rows, n_fields and the mean size of list columns over the first rows of a sample."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(rows.columns)).alias("n_fields"))
    sizes = rows.limit(sample).agg(*[F.avg(F.size(c)).alias(f"mean_{c}") for c in lists])
    return n.crossJoin(sizes)
