"""Live counts per time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotframe.operators.tables import read_batches, write_batch

COUNTS = T.StructType([T.StructField("period", T.TimestampType()), T.StructField("instruction_name", T.StringType()),
                       T.StructField("count", T.LongType())])


def stream_buckets(instructions: DataFrame, period: str = "hour", watermark: str | None = "1 day",
                   time: str = "indexed_at") -> DataFrame:
    """Instructions per (hour or day, name) as a streaming aggregate.

    ``watermark`` bounds the state; None where the stream already has one. Records
    later than it are missing here, but not in the batch query over the table.
    """
    rows = instructions.withColumn(time, F.col(time).cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark(time, watermark)
    width = "1 day" if period == "day" else "1 hour"
    return (rows.groupBy(F.window(time, width).alias("w"), "instruction_name").agg(F.count("*").alias("count"))
            .select(F.col("w.start").alias("period"), "instruction_name", "count"))


def write_buckets(counts: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Stores each micro-batch's changed counts; a repeated batch replaces its own."""
    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{path}/counts", batch_id)

    writer = (counts.writeStream.outputMode("update").foreachBatch(store)
              .option("checkpointLocation", f"{path}/checkpoint"))
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "5 seconds"})).start()


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every bucket."""
    stored = read_batches(spark, f"{path}/counts", COUNTS)
    return stored.groupBy("period", "instruction_name").agg(F.max_by("count", "batch_id").alias("count"))
