"""Keyed table maintenance on plain Parquet: insert if absent, upsert, replay-safe batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from slotframe.operators import manifest

BUCKET_SLOTS = 432_000
LISTED = 1000
"""Buckets of a batch that are compared as a list."""


def slot_bucket(slot: Column) -> Column:
    """Partition column of slot-ordered tables."""
    return F.floor(slot / BUCKET_SLOTS)


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


FIXED = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
"""Types that a hash aggregate can hold."""


def extreme_by(df: DataFrame, key: list[str], order: list[str], largest: bool) -> DataFrame:
    """One row per key, the smallest or largest by ``order``, ties settled by the other columns.

    Spark limits each task's rows to the first of every key before the shuffle, so copies of a
    key are reduced where they are and a key that holds much of the table never meets in one task.
    """
    ties = [c for c in df.columns if c not in key and c not in order and _sortable(df.schema[c].dataType)]
    by = [F.col(c).desc() if largest else F.col(c).asc() for c in (*order, *ties)] or [F.lit(0)]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    return df.withColumn("_turn", turn).where("_turn = 1").select(*df.columns)


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The largest row of every key where keys have many rows, in two phases.

    First a hash aggregate finds each key's largest value of the first order column; it reads the key and that
    column alone. Then a semi join fetches the rows that have it, about one for each key, and only these are
    sorted to settle what is equal so far. Rows that lose are never sorted, and cross the network at most once.
    """
    if not order or not isinstance(df.schema[order[0]].dataType, FIXED):
        return extreme_by(df, key, order, largest=True)
    names = [f"_k{i}" for i in range(len(key))]
    best = df.groupBy(*[F.col(c).alias(n) for c, n in zip(key, names)]).agg(F.max(order[0]).alias("_best"))
    same = F.col(order[0]).eqNullSafe(F.col("_best"))
    for c, n in zip(key, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return extreme_by(df.join(best.hint("shuffle_hash"), same, "left_semi"), key, order, largest=True)


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    return extreme_by(df, key, order, largest=False)


def covered(target: DataFrame, batch: DataFrame, prune: str | None) -> DataFrame:
    """The part of the target that lies in the batch's own values of ``prune``.

    ``prune`` names a column that a key determines (a slot bucket). Up to ``LISTED`` buckets become a filter, which
    prunes partitions before anything is planned, however far apart the buckets lie; more of them a join.
    """
    if prune is None:
        return target
    own = batch.select(prune).where(F.col(prune).isNotNull()).distinct()
    found = own.limit(LISTED + 1).collect()
    if len(found) <= LISTED:
        return target.where(F.col(prune).isin([r[0] for r in found]))
    return target.join(own, prune, "left_semi").select(*target.columns)


def new_only(batch: DataFrame, target: DataFrame, key: list[str], prune: str | None = None) -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    return batch.join(covered(target, batch, prune).select(*key), key, "left_anti")


def insert_if_absent(batch: DataFrame, target: DataFrame, key: list[str], order: list[str],
                     prune: str | None = None) -> DataFrame:
    """The rows to append: one per new key, the first by ``order``."""
    return new_only(first_by(batch, key, order), covered(target, batch, prune), key)


def upsert(target: DataFrame, batch: DataFrame, key: list[str], order: list[str],
           monotonic: bool = True) -> DataFrame:
    """Target and batch merged to one row per key.

    The largest by ``order`` wins. With ``monotonic=False`` any batch row beats the
    stored one (last write wins), and ``order`` decides within the batch.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rank = [*order, "_new"] if monotonic else ["_new", *order]
    return extreme_by(both, key, rank, largest=True).select(*target.columns)


# ---- stored tables ----------------------------------------------------------

def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Writes one batch as its own partition. Writing it again replaces it.

    With ``partition_by`` the rows are first rebalanced over those columns: few files
    per folder, while a folder that holds much of the batch is still written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """The table at a path; without rows if nothing was written there yet. Any other error is raised."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The stored table; with ``before`` only batches older than that one.

    A batch that is written again must not see its own earlier rows, or it would
    find nothing new and replace them with nothing.
    """
    full = T.StructType([*schema, T.StructField("batch_id", T.LongType())])
    stored = read_or_empty(spark, path, full, basePath=path)
    return stored if before is None else stored.where(F.col("batch_id") < before)


def write_ledger(batch: DataFrame, path: str, batch_id: int, key: list[str], order: list[str],
                 prune: str | None = None, partition_by: tuple[str, ...] = (), merge: bool = True) -> None:
    """Stores the new rows of a micro-batch in a table with a manifest. Repeating a batch changes nothing.

    With ``prune`` the table is partitioned by that column, so a batch is compared only with the buckets
    it has itself. The batch is then read twice, so persist it where that is expensive. With ``merge`` small folders
    are put together when there are many; a job of its own can do it instead (:func:`manifest.compact`).
    """
    spark = batch.sparkSession
    if manifest.committed(spark, path, batch_id):
        return
    if prune is not None and prune not in partition_by:
        partition_by = (prune, *partition_by)
    stored = manifest.read(spark, path, batch.schema, before=batch_id).select(*batch.columns)
    manifest.append(insert_if_absent(batch, stored, key, order, prune), path, batch_id, partition_by)
    if merge:
        manifest.compact(spark, path, batch.schema, partition_by)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The newest version of such a table, with the batch of each row; with ``before`` as it was before that batch."""
    return manifest.read(spark, path, schema, before)


def write_dispatched(dispatched: DataFrame, path: str, batch_id: int) -> None:
    """Instruction rows of all definitions in one pass.

    Partitioned by program and name, so that each typed table reads only its own part.
    """
    write_batch(dispatched, path, batch_id, ("program_id", "name"))


def append_states(decoded: DataFrame, path: str, batch_id: int, source: str, observed_at: Column) -> None:
    """Account states of one observation, from transactions or from a snapshot."""
    if source not in ("tx", "snapshot"):
        raise ValueError("source must be 'tx' or 'snapshot'")
    write_batch(decoded.withColumn("source", F.lit(source)).withColumn("observed_at", observed_at), path, batch_id)


def upsert_partitions(spark: SparkSession, path: str, batch: DataFrame, key: list[str], order: list[str],
                      partition: str, monotonic: bool = True) -> None:
    """Upsert into a table of versioned partitions, rewriting only the partitions the batch touches.

    ``partition`` must follow from the key. Their new versions are written beside the old ones and count from
    the moment the manifest lists them, so a failure at any time leaves the table as it was.
    """
    touched = batch.select(partition).distinct()
    target = manifest.read_partitions(spark, path, batch.schema, partition)
    merged = upsert(target.join(touched, partition, "left_semi").select(*batch.columns), batch, key, order, monotonic)
    manifest.replace_partitions(merged, path, partition, touched)


def read_upserted(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> DataFrame:
    """The table that :func:`upsert_partitions` keeps."""
    return manifest.read_partitions(spark, path, schema, partition)


def progress(batch: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Sync-state rows of a batch: the furthest position per program."""
    furthest = F.max(F.struct(F.col("slot").alias("last_slot"), F.col("signature").alias("last_signature")))
    stamp = F.current_timestamp() if updated_at is None else updated_at
    return (batch.groupBy("program_id").agg(furthest.alias("p"))
            .select("program_id", "p.*", stamp.alias("updated_at")))


def last_processed(sync_state: DataFrame, program_id: str) -> DataFrame:
    """(last_slot, last_signature) of a program; no row when it was never seen."""
    return sync_state.where(F.col("program_id") == program_id).select("last_slot", "last_signature")


def bridge(history: DataFrame, live: DataFrame, key: list[str] | None = None,
           order: list[str] | None = None) -> DataFrame:
    """History and live records together, each key once."""
    both = history.unionByName(live)
    key = key or ["signature"]
    return first_by(both, key, order or [c for c in both.columns if c not in key])
