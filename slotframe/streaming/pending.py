"""Notified records that are not there yet: looked for again until a deadline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotframe.operators import manifest
from slotframe.operators.tables import first_by
from slotframe.streaming.ingest import stamp_of

WAITING = T.StructType([T.StructField("signature", T.StringType()), T.StructField("since", T.TimestampType())])


def follow_notifications(notifications: DataFrame, arrivals: DataFrame, stored: Callable[[SparkSession], DataFrame], path: str,
                         deadline: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """Full records for notified signatures, also for those that land later than their notification.

    One query over both streams. New notifications are looked up in ``stored``, the record table as it
    is now; those without a record wait in a table of their own, and every batch of arriving records is compared with it, so
    nothing is scanned again for them. What has waited longer than ``deadline`` moves to another table. A signature
    that is notified several times in a batch, or while it waits, counts once.

    The tables are ``{path}/found``, ``{path}/waiting`` and ``{path}/expired``. Each batch is committed to all of
    them, the waiting one last, so a batch that is repeated gives the same rows.
    """
    columns = arrivals.columns
    both = notifications.select("signature", F.lit(True).alias("_note")).unionByName(
        arrivals.withColumn("_note", F.lit(False)), allowMissingColumns=True)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if manifest.committed(spark, f"{path}/waiting", batch_id):
            return
        now = F.lit(stamp_of(spark, f"{path}/stamps", batch_id))
        batch.persist()
        try:
            waiting = manifest.read(spark, f"{path}/waiting", WAITING, before=batch_id).select("signature", "since")
            new = batch.where("_note").select("signature").distinct().join(waiting, "signature", "left_anti")
            came = batch.where("not _note").select(*columns)
            hits = stored(spark).select(*columns).join(new, "signature", "left_semi").unionByName(
                came.join(waiting, "signature", "left_semi"))
            manifest.append(first_by(hits, ["signature"], []), f"{path}/found", batch_id)
            found = manifest.read(spark, f"{path}/found", arrivals.schema).where(F.col("batch_id") == batch_id)
            left = waiting.unionByName(new.withColumn("since", now)).join(found.select("signature"), "signature", "left_anti")
            over = F.col("since") + F.expr(f"INTERVAL {deadline}") <= now
            manifest.append(left.where(over), f"{path}/expired", batch_id)
            manifest.replace(left.where(~over), f"{path}/waiting", batch_id)
        finally:
            batch.unpersist()
        manifest.compact(spark, f"{path}/found", arrivals.schema)
        manifest.compact(spark, f"{path}/expired", WAITING)

    writer = both.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "5 seconds"})).start()


def found_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return manifest.read(spark, f"{path}/found", schema).select(*schema.names)


def waiting_notifications(spark: SparkSession, path: str) -> DataFrame:
    """Signatures without a record so far, with the time they were first notified."""
    return manifest.read(spark, f"{path}/waiting", WAITING).select("signature", "since")


def expired_notifications(spark: SparkSession, path: str) -> DataFrame:
    """Signatures whose record did not come in time."""
    return manifest.read(spark, f"{path}/expired", WAITING).select("signature", "since")
