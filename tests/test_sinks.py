"""Appending sinks that may be run again: a run that ended half-way, a repeated one, a stream without its checkpoint."""

from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import answers

SCHEMA = "id long, text string"


def held(spark, folder):
    return sorted(map(tuple, files.read_lines(spark, folder, SCHEMA).select("id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_a_run_that_ended_half_way_leaves_each_id_once(spark, tmp_path):
    folder = str(tmp_path / "rows")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(None, "no id"), (7, "t7")], SCHEMA).repartition(5)
    files.append_new(rows.where("id < 40"), folder, "id")
    part = next(p for p in (tmp_path / "rows").iterdir() if p.suffix == ".json" and p.stat().st_size)
    part.unlink()  # a file that the first run didn't get to
    (tmp_path / "rows" / f".{part.name}.crc").unlink(missing_ok=True)
    assert len(held(spark, folder)) < 40
    for _ in range(2):
        files.append_new(rows, folder, "id")
        assert held(spark, folder) == [(i, f"t{i}") for i in range(100)] + [(None, "no id")]
    files.append_new(rows.withColumn("text", F.lit("later")), folder, "id")
    assert held(spark, folder)[3] == (3, "t3")
    files.append_new(rows.limit(0), str(tmp_path / "none"), "id")


def test_a_stream_without_its_checkpoint_leaves_each_id_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(30).select("id", F.concat(F.lit("t"), "id").alias("text")).repartition(3).write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = answers.append_keys(stream, folder, str(tmp_path / f"checkpoint{run}"), "id")
        assert query.awaitTermination(120) and query.exception() is None
        assert held(spark, folder) == [(i, f"t{i}") for i in range(30)]
        spark.range(30, 40).select("id", F.concat(F.lit("t"), "id").alias("text")).limit(0).write.mode("append").parquet(source)
