"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 512
"""A key with more than this fraction (one over it) of all rows is hot; so there are never more hot keys than this."""
SPREAD = 1 << 20


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int | Column, spread: Column) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row for each key and its number of rows in ``count``.

    Keys with over 1/HOT_SHARE of ``total`` rows, at most HOT_SHARE of them by arithmetic, are
    broadcast; their rows are dealt out by ``spread`` afterwards, so none of them fills a task.
    Other keys meet by an ordinary join. Rows with a null key find nothing.
    """
    values = [c for c in right.columns if c not in (key, count)]
    hot = right.where(F.col(count) * HOT_SHARE > total).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    # 0 in a form that is no literal: else the part number would be tested beside the join instead of being a key of it
    zero = F.when(F.col(count) > 0, 0).otherwise(1)
    cold = right.where(F.col(count) * HOT_SHARE <= total).select(
        F.col(key).alias("_match"), zero.alias("_part"), F.struct(*values).alias("_cold"))
    met = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    alone = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    met = met.withColumn("_part", F.when(alone, 1 + F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int")).otherwise(0))
    # rows that are dealt out carry some value; their part number keeps it from matching
    kind = right.schema[key].dataType.simpleString()
    nothing = F.lit("").cast(kind) if kind in ("string", "binary") else F.lit(0).cast(kind)
    met = met.withColumn("_match", F.when(F.col("_part") == 0, F.col(key)).otherwise(nothing))
    met = met.join(cold, ["_match", "_part"], "left")
    return met.select(*left.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])
