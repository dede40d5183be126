"""Answer counts over streams: the summaries of repeated answers, in windows of event time with a watermark. An extension, not parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import append_new


def windowed_answers(events: DataFrame, key: str, answer: str, time: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, key, answer, n of a stream or a table; rows later than ``late`` are dropped by a stream."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), key, answer)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), key, answer, "n")
    )


def append_lines(stream: DataFrame, folder: str, checkpoint: str):
    """Append finished windows as Parquet, each once, as they close; what is there is kept by a restart."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_keys(stream: DataFrame, folder: str, checkpoint: str, key: str):
    """Append rows as line JSON, each ``key`` once, also when the stream starts anew without its checkpoint or a batch is repeated."""
    return stream.writeStream.foreachBatch(lambda rows, _: append_new(rows, folder, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
