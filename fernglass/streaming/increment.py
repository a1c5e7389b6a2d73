"""Passages that arrive as a stream of files, added to a stored corpus once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def add_stream(spark: SparkSession, source: str, schema, target: str, state: str) -> StreamingQuery:
    """Reads parquet files as they arrive under ``source`` and appends passages with new ids to ``target``.

    The stored table itself is the memory of what was seen, by an anti-join in
    every batch; a watermark would lose rows that arrive later than it allows.
    Processes what is there and ends; started again, it goes on where it ended.
    """
    x = spark.readStream.schema(schema).parquet(source).where("passage_id is not null")

    def append(batch: DataFrame, number: int) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        fresh = batch.dropDuplicates(["passage_id"])
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            # a batch that runs again after a failure has rows of its own there, and replaces them
            old = spark.read.schema(batch.withColumn("added_in", F.lit(number)).schema).parquet(target).where(F.col("added_in") != number)
            fresh = fresh.join(old.select("passage_id"), "passage_id", "left_anti")
        fresh.withColumn("added_in", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("added_in").parquet(target)

    return x.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()


def counts_by_window(spark: SparkSession, source: str, schema, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """A streaming frame (start, event_type, n, total): events per window, closed when the watermark passes it."""
    x = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late)
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
