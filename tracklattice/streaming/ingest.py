"""Streams of events and observations, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.operators.resolve import delivered_once
from tracklattice.session import shared_dir


def _stream(spark: SparkSession, path: str, per_batch: int) -> DataFrame:
    """A file, or the files of a folder, as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", per_batch).parquet(path if _is_folder(spark, path) else f"{folder}/[{name[0]}]{name[1:]}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def hourly_counts(spark: SparkSession, path: str, lateness: str = "1 hour", per_batch: int = 8) -> DataFrame:
    """Rows (start, event_type, n, total) of tumbling hours, run until the stream has caught up.

    Update mode: a batch writes the hours it has changed, under its own number, so one that runs again replaces itself; the newest row of an hour
    counts when the table is read. The state holds the hours that the watermark has not passed; events later than `lateness` are left out.
    """
    out = f"{shared_dir(spark)}/hours-{uuid.uuid4().hex}"
    events = _stream(spark, path, per_batch).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{out}/parts/batch={epoch}")

    q = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.parquet(f"{out}/parts")
    newest = F.max_by(F.struct("n", "total"), "batch").alias("x")
    return parts.groupBy("start", "event_type").agg(newest).select("start", "event_type", "x.n", "x.total")


def ingested_observations(spark: SparkSession, path: str, per_batch: int = 4) -> DataFrame:
    """Observations of a stream merged by id, batch by batch: the last delivery of each stays.

    A batch is reduced by itself and written under its number, so a batch that runs again after a failure replaces itself; the
    parts are reduced once more when they are read.
    """
    out = f"{shared_dir(spark)}/observations-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        delivered_once(batch).write.mode("overwrite").parquet(f"{out}/parts/batch={epoch}")

    q = _stream(spark, path, per_batch).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return delivered_once(spark.read.parquet(f"{out}/parts").drop("batch")).where("observation_id is not null")
