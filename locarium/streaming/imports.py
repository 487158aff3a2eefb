"""Streaming import. An extension: the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locarium.operators.merge import merged


def import_stream(incoming: DataFrame, store: str, fields: list[str], policy: str, checkpoint: str):
    """Merge each micro-batch of a stream into the table at ``store`` under a policy.

    ``incoming`` has id, fields, file_rank and row_idx. Every batch writes a new version
    folder and then names it in ``current``, so that a batch that is run again, or one that
    fails half way, leaves the last whole version.
    """

    def version(spark, batch: DataFrame, n: int) -> None:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        marker = fs_path(f"{store}/current")
        fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        columns = ["id", *fields]
        if fs.exists(marker):
            last = spark.read.text(str(marker)).first()[0]
            if int(last) == n:
                return  # this batch is in already
            old = spark.read.parquet(f"{store}/v{last}")
        else:
            old = batch.select(*columns).limit(0)
        merged(old.select(*columns), batch, fields, policy).write.mode("overwrite").parquet(f"{store}/v{n}")
        out = fs.create(marker, True)
        out.write(bytearray(f"{n}\n".encode()))
        out.close()

    return incoming.writeStream.foreachBatch(lambda batch, n: version(batch.sparkSession, batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, store: str) -> DataFrame:
    """The last whole version."""
    return spark.read.parquet(f"{store}/v{spark.read.text(f'{store}/current').first()[0]}")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, with a watermark for late events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
