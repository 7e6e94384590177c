"""Streams of landed records and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Commitment levels, weakest first.
COMMITMENTS = ("processed", "confirmed", "finalized")


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None,
                name_filter: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream. ``files_per_trigger`` keeps micro-batches bounded."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def stream_program(raw: DataFrame, program_ids: list[bytes], keys: str = "account_keys") -> DataFrame:
    """Records that mention any of the programs among their account keys."""
    return raw.where(F.arrays_overlap(F.col(keys), F.array(*[F.lit(p) for p in program_ids])))


def stream_filter(raw: DataFrame, vote: bool | None = False, failed: bool | None = None,
                  include: list[bytes] | None = None, commitment: str | None = "confirmed",
                  keys: str = "account_keys") -> DataFrame:
    """Structured filters; None leaves a predicate out. ``commitment`` is the least level wanted."""
    rows = raw
    if vote is not None:
        rows = rows.where(F.col("is_vote") == vote)
    if failed is not None:
        rows = rows.where(F.col("err").isNotNull() if failed else F.col("err").isNull())
    if commitment is not None:
        rows = rows.where(F.col("commitment").isin(*COMMITMENTS[COMMITMENTS.index(commitment):]))
    return rows if include is None else stream_program(rows, include, keys)


def enrich_notifications(notifications: DataFrame, raw: DataFrame, on: tuple[str, ...] | None = None) -> DataFrame:
    """Full records for notified signatures: a stream-static join, read afresh per micro-batch.

    Where both sides have ``slot_bucket`` it is part of the key: the record table is then
    pruned to the buckets of the micro-batch.
    """
    if on is None:
        both = "slot_bucket" in notifications.columns and "slot_bucket" in raw.columns
        on = ("signature", "slot_bucket") if both else ("signature",)
    return notifications.select(*on).join(raw, list(on))


def missing_notifications(batch: DataFrame, raw: DataFrame) -> DataFrame:
    """Notified signatures without a record yet; for use inside ``foreachBatch``, to be looked up again."""
    return batch.select("signature").distinct().join(raw.select("signature"), "signature", "left_anti")


def retry_missing(missing: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Another look for notified records that were not there: what has come since, and what is still missing."""
    return enrich_notifications(missing, raw), missing.join(raw.select("signature"), "signature", "left_anti")
