"""Counts of a running ingest, taken on the way."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from slotframe.operators import manifest

# What can become of a landed record.
OUTCOMES = ("ok", "missing", "bad_base64", "bad_message")
COUNTS = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("status", T.StringType()),
                       T.StructField("records", T.LongType())])


def observed(df: DataFrame, name: str, status: Column, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """The same rows; Spark counts outcomes while they pass, without a job or a shuffle of its own. Others are ``other``."""
    known = [F.count_if(status == o).alias(o) for o in outcomes]
    other = F.count_if(~F.coalesce(status.isin(list(outcomes)), F.lit(False))).alias("other")
    return df.observe(name, *known, other)


class CountWriter(StreamingQueryListener):
    """Writes the counts of every batch of an observed stream as a small file; a batch that is repeated keeps its first.

    Add it with ``spark.streams.addListener`` before the query starts."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path, self.seen = spark, name, path, -1

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        batch_id = event.progress.batchId
        lines = [json.dumps({"batch_id": batch_id, "status": k, "records": v}) for k, v in row.asDict().items() if v]
        if lines:
            manifest.put_once(self.spark, f"{self.path}/{batch_id:015d}.json", "\n".join(lines))
        self.seen = max(self.seen, batch_id)

    def onQueryTerminated(self, event: object) -> None:
        pass

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the counts of the last finished batch have come; they are delivered a little later than the batch."""
        last = query.lastProgress
        until = time.monotonic() + seconds
        while last is not None and self.seen < last.batchId:
            if time.monotonic() > until:
                raise TimeoutError(f"no counts for batch {last.batchId}")
            time.sleep(0.05)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, status, records) of all batches."""
    return spark.read.schema(COUNTS).json(path) if manifest.names_in(spark, path) else spark.createDataFrame([], COUNTS)
