"""History and live records into tables, each record once, over restarts and replays."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotframe.operators import manifest
from slotframe.operators.tables import progress, read_ledger, write_ledger
from slotframe.plans.schemas import SYNC_STATE


@dataclass(frozen=True)
class Sink:
    """Where an ingest writes: ``{path}/rows``, ``{path}/sync_state``, and its checkpoint."""
    path: str
    key: tuple[str, ...]
    order: tuple[str, ...]
    prune: str | None = None
    partition_by: tuple[str, ...] = ()

    @property
    def rows(self) -> str:
        return f"{self.path}/rows"

    @property
    def states(self) -> str:
        return f"{self.path}/sync_state"

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"


def run_ingest(history: DataFrame, live: DataFrame, sink: Sink, track_progress: bool = True,
               available_now: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """One query over history and live records.

    Run it with ``available_now`` to catch up, then without to follow. Both use the
    same checkpoint and the same two sources, so nothing lies between backfill and
    live, and a restart repeats the last batch under its old number. Duplicates are
    removed against the table, which keeps records of any age.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        stamp = F.lit(batch_stamp(batch.sparkSession, sink, batch_id))
        batch.persist()
        try:
            write_ledger(batch, sink.rows, batch_id, list(sink.key), list(sink.order), sink.prune, sink.partition_by)
            if track_progress:
                manifest.append(progress(batch, stamp), sink.states, batch_id)
                manifest.compact(batch.sparkSession, sink.states, SYNC_STATE)
        finally:
            batch.unpersist()

    writer = (history.unionByName(live).writeStream.foreachBatch(store)
              .option("checkpointLocation", sink.checkpoint))
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def stamp_of(spark: SparkSession, folder: str, batch_id: int) -> datetime:
    """The time a batch was first seen. It is written before anything else of the batch, so a replay has the same."""
    manifest.put_once(spark, f"{folder}/{batch_id:015d}", datetime.now(timezone.utc).isoformat())
    return datetime.fromisoformat(manifest.get_text(spark, f"{folder}/{batch_id:015d}"))


def batch_stamp(spark: SparkSession, sink: Sink, batch_id: int) -> datetime:
    return stamp_of(spark, f"{sink.path}/stamps", batch_id)


def ingested(spark: SparkSession, sink: Sink, schema: T.StructType) -> DataFrame:
    """The stored rows."""
    return read_ledger(spark, sink.rows, schema).select(*schema.names)


def sync_state(spark: SparkSession, sink: Sink) -> DataFrame:
    """Furthest position per program. It never moves back, whatever order records came in."""
    rows = read_ledger(spark, sink.states, SYNC_STATE)
    position = F.max(F.struct("last_slot", "last_signature", "updated_at")).alias("p")
    return rows.groupBy("program_id").agg(position).select("program_id", "p.*")


def dedup_stream(df: DataFrame, key: list[str], time: str, horizon: str) -> DataFrame:
    """Duplicates removed within a time horizon, for streams that feed live counts.

    State is bounded by the horizon, so records behind it are dropped. Tables use
    ``run_ingest``, which drops nothing.
    """
    return df.withWatermark(time, horizon).dropDuplicatesWithinWatermark(key)
