"""Tables of patients written from the events and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import query, table
from tessera.sources import patients as P
from tessera.sources.scratch import shared_folder

_ENTRIES = "SELECT event_type || '_@_V_' || user_id AS one, 'it''s \"' || event_type || '\", ' || (user_id % 10) AS other, event_id % 7 AS kind FROM events"


def _patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patient an event with a list, a dictionary, a list over two lines, nothing, or half a list, written as CSV files."""
    one = F.concat("event_type", F.lit("_@_V_"), F.col("user_id").cast("string"))
    other = F.concat(F.lit("it\\'s \""), F.col("event_type"), F.lit('", '), F.pmod("user_id", F.lit(10)).cast("string"))
    text = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    both = [F.concat(F.lit("["), text(one), F.lit(", "), text(other), F.lit("]")), F.concat(F.lit("{"), text(one), F.lit(": False, "), text(other), F.lit(": True}")), F.concat(F.lit("["), text(one), F.lit(",\n"), text(other), F.lit("]"))]
    raw = F.get(F.array(*both, F.lit(""), F.concat(F.lit("["), text(one)), F.lit("5"), both[0]), F.pmod("event_id", F.lit(7)).cast("int"))
    place = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    table(spark, sf_dir, "events").select("event_id", raw.alias("EVIDENCES"), F.col("event_type").alias("PATHOLOGY")).write.csv(place, header=True, quote='"', escape='"')
    return P.read_patients(spark, place)


@query("entries_in_use", f"WITH e AS ({_ENTRIES}) SELECT DISTINCT one AS entry FROM e WHERE kind IN (0, 1, 2, 6) UNION SELECT DISTINCT other FROM e WHERE kind IN (0, 1, 2, 6)")
def entries_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entries_in_use(_patients(spark, sf_dir))


@query("patient_reading", f"WITH e AS ({_ENTRIES}) SELECT count(*) AS n_rows, count(*) FILTER (kind IN (4, 5)) AS unreadable, count(*) FILTER (kind = 3) AS empty, 2 * count(*) FILTER (kind IN (0, 1, 2, 6)) AS n_items FROM e")
def patient_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reading(_patients(spark, sf_dir))
