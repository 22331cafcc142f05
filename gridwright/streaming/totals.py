"""Running totals over a stream of events, with late rows bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.checkpoints import ensure_checkpoint_dir


def windowed(events: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value for each window and kind; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def totals_of(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, n, total of the events table, read as a stream of what is there now; each batch writes the totals so far as Parquet."""
    ensure_checkpoint_dir(spark)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/totals-{uuid.uuid4().hex}"
    sums = stream.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    last: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")  # a batch that is run again replaces its own files
        last[:] = [f"{base}/out/{number}"]

    run = sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(*last) if last else spark.createDataFrame([], sums.schema)
