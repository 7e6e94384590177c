"""What several operators of this subpackage share: stored steps, hot-key joins, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.operators.skew import join_counted  # noqa: F401 (used by the operators)
from slotframe.session import new_path

WORD = r"[^\x20\x09-\x0D]+"
"""A word: what lies between spaces and the control characters 9 to 13."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read from there: later steps start from files
    that outlive any executor, and nothing before them runs twice."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have about ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size.astype(np.int64)) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
