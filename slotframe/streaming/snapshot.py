"""Periodic account snapshots that store only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotframe.operators import manifest
from slotframe.operators.decode import write_derived
from slotframe.operators.dispatch import dispatch
from slotframe.operators.lookups import latest_accounts
from slotframe.operators.tables import read_upserted, upsert_partitions
from slotframe.plans.types import Interface
from slotframe.sources.ledger import scan_accounts

KEY = ["program_id", "name", "pubkey"]
BUCKETS = 64
"""Parts of the table of hashes; a snapshot rewrites those in which an account has changed."""


def digest(df: DataFrame, data: str = "data") -> DataFrame:
    """Adds ``data_hash``, which stands for the bytes in every later comparison."""
    return df.withColumn("data_hash", F.sha2(F.col(data), 256))


def snapshot_job(raw_accounts: DataFrame, definitions: DataFrame | list[Interface], previous: DataFrame,
                 program_ids: list | DataFrame | None = None) -> DataFrame:
    """Accounts of known types whose bytes differ from the last stored state.

    ``previous`` needs (program_id, name, pubkey, data_hash, observed_at, slot); only
    the hashes of it are shuffled. An account seen several times in the snapshot
    counts once, with its latest observation.
    """
    rows = raw_accounts if program_ids is None else scan_accounts(raw_accounts, program_ids)
    typed = dispatch(rows.withColumnRenamed("owner", "program_id"), definitions, "account").where("matched")
    current = digest(latest_accounts(typed, tuple(KEY)))
    stored = latest_accounts(previous.select(*KEY, "observed_at", "slot", "data_hash"), tuple(KEY))
    known = stored.select(*KEY, F.col("data_hash").alias("stored_hash"))
    changed = current.join(known, KEY, "left")
    return changed.where(~F.col("data_hash").eqNullSafe(F.col("stored_hash"))).drop("stored_hash")


def run_snapshots(raw_accounts: DataFrame, interfaces: list[Interface], path: str, available_now: bool = True) -> StreamingQuery:
    """A stream of snapshots into the derived account tables ``{path}/tables``: each micro-batch is compared with the
    hashes of what is stored, and only accounts that differ are decoded and added, with source and time of observation.

    The changed rows of a batch are written first, under its number; everything after starts from them, so a batch
    that is repeated, whole or from the middle, leaves the same tables. ``raw_accounts`` need (pubkey, owner, data, slot, observed_at).
    """
    owner, key = raw_accounts.schema["owner"].dataType, raw_accounts.schema["pubkey"].dataType
    hashes = T.StructType([
        T.StructField("program_id", owner), T.StructField("name", T.StringType()), T.StructField("pubkey", key),
        T.StructField("data_hash", T.StringType()), T.StructField("observed_at", raw_accounts.schema["observed_at"].dataType),
        T.StructField("slot", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = read_upserted(spark, f"{path}/hashes", hashes, "bucket")
        changed = snapshot_job(batch, interfaces, previous)
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
        manifest.append(changed, f"{path}/changed", batch_id)
        rows = manifest.read(spark, f"{path}/changed", changed.schema).where(F.col("batch_id") == batch_id).drop("batch_id")
        for face in interfaces:
            write_derived(rows.drop("data_hash"), face, f"{path}/tables", batch_id, "account", source="snapshot")
        upsert_partitions(spark, f"{path}/hashes", rows.withColumn("bucket", bucket).select(*hashes.names), KEY,
                          ["observed_at", "slot"], "bucket")

    writer = raw_accounts.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "30 seconds"})).start()
