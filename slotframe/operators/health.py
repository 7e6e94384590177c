"""Request-log health: moving average of latency and the ranking of sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a new sample, start values, lag limit and its penalty.
ALPHA, SEED = 0.2, 1000.0
START_COUNT, LAG_LIMIT, LAG_PENALTY = 1, 10, 0.5

NO_SLOT = -1 << 63
FOLDED = "part int, gain double, add double, good long, total long, last_slot long"


def _then(first: Column, second: Column) -> Column:
    """The map x -> gain * x + add that applies ``first``, then ``second``."""
    return F.struct((second["gain"] * first["gain"]).alias("gain"),
                    (second["gain"] * first["add"] + second["add"]).alias("add"))


def _runs(batch: pa.RecordBatch, alpha: float) -> Iterator[tuple]:
    """(key as an array of one, part, gain, add, good, total, last slot) of each run of one key in a sorted batch.

    A request that moves the average is x -> (1 - alpha) x + alpha * sample; others are the identity map.
    """
    key = batch.column("key")
    codes = pc.fill_null(key.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.append(starts, len(codes)))
    sample = pc.fill_null(batch.column("sample"), np.nan).to_numpy(zero_copy_only=False)
    moves = ~np.isnan(sample)
    passed = np.cumsum(moves)
    left = np.repeat(passed[starts + sizes - 1], sizes) - passed
    adds = np.add.reduceat(np.where(moves, alpha * sample * (1 - alpha) ** left, 0.0), starts)
    gains = (1 - alpha) ** np.add.reduceat(moves.astype(np.int64), starts)
    good = np.add.reduceat(batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64), starts)
    slots = np.maximum.reduceat(pc.fill_null(batch.column("slot"), NO_SLOT).to_numpy(zero_copy_only=False), starts)
    part = batch.column("part")[0].as_py()
    for i, lo in enumerate(starts.tolist()):
        yield key.slice(lo, 1), part, float(gains[i]), float(adds[i]), int(good[i]), int(sizes[i]), int(slots[i])


def _fold_range(alpha: float) -> object:
    """One row for each key of a sorted range. Only the fold of the key at hand is held, however many rows it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for found in _runs(batch, alpha) if batch.num_rows else ():
                if held is not None and held[0].equals(found[0]):
                    _, part, gain, add, good, total, slot = held
                    held = (found[0], part, gain * found[2], add * found[2] + found[3], good + found[4], total + found[5],
                            max(slot, found[6]))
                    continue
                if held is not None:
                    yield _row(held)
                held = found
        if held is not None:
            yield _row(held)
    return run


def _row(held: tuple) -> pa.RecordBatch:
    key, part, gain, add, good, total, slot = held
    return pa.RecordBatch.from_arrays(
        [key, pa.array([part], pa.int32()), pa.array([gain]), pa.array([add]), pa.array([good]), pa.array([total]),
         pa.array([None if slot == NO_SLOT else slot], pa.int64())],
        names=["key", "part", "gain", "add", "good", "total", "last_slot"])


def _fold(log: DataFrame, key: str, order: tuple[str, ...], value: str, ok: str, alpha: float, slot: str | None) -> DataFrame:
    """Per key: the affine map of its whole history (gain, add), the counts, and the last slot.

    One step is an affine map, and affine maps compose. The log is cut into ranges of (key, order), each is
    folded while it streams by, and a key's ranges, one row each, are composed in their order. So a busy key takes as many
    ranges as it needs and never gathers in one task. Rows equal in ``order`` are told apart by their values;
    rows equal in those too may come in any order.
    """
    good = F.coalesce(F.col(ok), F.lit(False))
    steps = log.select(
        F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], good.alias("good"),
        F.when(good, F.col(value).cast("double")).alias("sample"),
        F.when(good, F.col(slot) if slot else F.lit(None)).cast("bigint").alias("slot"))
    by = ["key", *[f"o{i}" for i in range(len(order))], "good", "sample", "slot"]
    # The number of ranges is named: adaptive execution would otherwise join small ones after their numbers are given.
    ranges = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = steps.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    ranged = ranged.select("key", "good", "sample", "slot", F.spark_partition_id().alias("part"))
    kind = ranged.schema["key"].dataType.simpleString()
    folded = ranged.mapInArrow(_fold_range(alpha), f"key {kind}, {FOLDED}")
    in_order = F.sort_array(F.collect_list(F.struct("part", F.struct("gain", "add").alias("m"))))
    identity = F.struct(F.lit(1.0).alias("gain"), F.lit(0.0).alias("add"))
    return folded.groupBy("key").agg(
        F.aggregate(in_order, identity, lambda a, x: _then(a, x["m"])).alias("m"), F.sum("good").alias("good"),
        F.sum("total").alias("total"), F.max("last_slot").alias("last_slot"))


def ema(log: DataFrame, key: str = "source", order: str | Sequence[str] = "seq", value: str = "latency_ms", ok: str = "ok",
        alpha: float = ALPHA, seed: float = SEED) -> DataFrame:
    """Exponential moving average per key over the successful requests, in order.

    ``order`` is a column or several (a time and what settles ties); it may repeat, then smaller values come first.
    A request whose ``ok`` is null counts as failed, one without a value moves nothing. A key without any
    success keeps the seed; the null key is a key.
    """
    order = (order,) if isinstance(order, str) else tuple(order)
    return _fold(log, key, order, value, ok, alpha, None).select(
        F.col("key").alias(key), (F.col("m")["gain"] * seed + F.col("m")["add"]).alias("ema"))


def source_scores(log: DataFrame) -> DataFrame:
    """Success rate over latency, halved for sources far behind the best; best first."""
    best = log.where("ok").select(F.coalesce(F.max("slot"), F.lit(0))).scalar()
    rows = _fold(log, "source", ("seq",), "latency_ms", "ok", ALPHA, "slot").select(
        F.col("key").alias("source"), (F.col("good") + START_COUNT).alias("success_count"),
        (F.col("total") + START_COUNT).alias("total_count"),
        F.coalesce("last_slot", F.lit(0)).alias("last_slot"),
        (F.col("m")["gain"] * SEED + F.col("m")["add"]).alias("ema"))
    lagging = best - F.col("last_slot") > LAG_LIMIT
    score = (F.col("success_count") / F.col("total_count")
             / F.greatest("ema", F.lit(1.0)) * F.when(lagging, LAG_PENALTY).otherwise(1.0))
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), "source")
