"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir or the context's own checkpoint folder names; where neither is set, which only a local master may leave out, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again, so that what is read is the same each time; the table goes when the application ends."""
    spark = frame.sparkSession
    place = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    frame.write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)
