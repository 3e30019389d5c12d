"""New slides as a stream: each arrival is worked on once, its status appended to a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.rows import not_done


def work_off(spark: SparkSession, arrivals: str, schema: str, done: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "slide_id") -> int:
    """Take what arrived in a folder since the last call, skip keys that have a result, and append
    the results of the rest. A batch that runs again after a failure finds its own results and
    adds nothing twice. Returns the number of batches."""
    stream = spark.readStream.schema(schema).parquet(arrivals)

    def batch(rows: DataFrame, _: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(done)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = not_done(rows, spark.read.parquet(done), key)
        work(rows.dropDuplicates([key])).write.mode("append").parquet(done)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def windowed_rates(events: DataFrame, time: str, group: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window of event time; works on streams and tables alike."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, length).alias("w"), group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), group, "n", "total")
    )
