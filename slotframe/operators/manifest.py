"""Tables of Parquet folders listed in a manifest.

A table is a folder with ``data/`` and ``manifest/``. Data is written to folders of their own, which nobody sees until a
manifest that lists them appears, under its final name and complete. A reader takes the newest manifest and reads what it
lists, so it sees one version; a writer that fails in between leaves the last version as it was. Manifests are numbered by
the batch that wrote them and a step; a batch that comes again finds its manifest and does nothing.

Small folders of many batches are merged as in a log-structured store: neighbours are put together as
long as the older one is no larger than all newer ones together. Sizes then fall by half at least, so a table of
any age has few folders, and a row is rewritten a logarithmic number of times. Nothing is deleted; :func:`unlisted`
names folders that no manifest from a given batch on needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8
"""Folders that a table may have before they are merged."""


@dataclass(frozen=True)
class Segment:
    """One data folder: the batches whose rows it holds, and its size."""
    folder: str
    first: int
    last: int
    bytes: int


def _at(spark: SparkSession, path: str) -> tuple[object, object]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist. One listing, whatever lies below."""
    fs, place = _at(spark, folder)
    return sorted(entry.getPath().getName() for entry in fs.listStatus(place)) if fs.exists(place) else []


def size_of(spark: SparkSession, folder: str) -> int:
    fs, place = _at(spark, folder)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that appears complete under its name; False if it was there before."""
    fs, place = _at(spark, path)
    if fs.exists(place):
        return False
    _, aside = _at(spark, f"{place.getParent().toString()}/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    return fs.rename(aside, place)


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# ---- versions ---------------------------------------------------------------

def version_name(batch_id: int, step: int = 0) -> str:
    return f"{batch_id:015d}-{step:04d}.json"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete manifests, oldest first."""
    return [n for n in names_in(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]


def segments(spark: SparkSession, path: str, before: int | None = None) -> list[Segment]:
    """What the newest manifest lists, oldest first; with ``before`` the newest of batches older than that one."""
    known = [n for n in versions(spark, path) if before is None or n < version_name(before)]
    return [Segment(**s) for s in json.loads(get_text(spark, f"{path}/manifest/{known[-1]}"))] if known else []


def commit(spark: SparkSession, path: str, batch_id: int, listed: list[Segment], step: int = 0) -> bool:
    return put_once(spark, f"{path}/manifest/{version_name(batch_id, step)}", json.dumps([asdict(s) for s in listed]))


def committed(spark: SparkSession, path: str, batch_id: int) -> bool:
    return get_text(spark, f"{path}/manifest/{version_name(batch_id)}") is not None


def write_segment(df: DataFrame, path: str, first: int, last: int, partition_by: tuple[str, ...] = ()) -> Segment:
    """The rows as a folder of its own, not yet listed. Files are filled to Spark's advisory size, however many tasks there are."""
    folder = f"data/segment={first:015d}-{last:015d}-{uuid.uuid4().hex}"
    writer = df.hint("rebalance", *partition_by).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{folder}")
    return Segment(folder, first, last, size_of(df.sparkSession, f"{path}/{folder}"))


def read_segments(spark: SparkSession, path: str, schema: T.StructType, listed: list[Segment]) -> DataFrame:
    """The rows of the listed folders with their ``batch_id``; folders without files count as empty."""
    full = T.StructType([*schema, T.StructField("batch_id", T.LongType())])
    filled = [f"{path}/{s.folder}" for s in listed if s.bytes]
    if not filled:
        return spark.createDataFrame([], full)
    found = T.StructType([*full, T.StructField("segment", T.StringType())])
    return spark.read.schema(found).option("basePath", f"{path}/data").parquet(*filled).select(*full.names)


# ---- tables -----------------------------------------------------------------

def append(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> bool:
    """Adds the rows of a batch. If the batch is in the table already, nothing happens and the result is False."""
    spark = df.sparkSession
    if committed(spark, path, batch_id):
        return False
    listed = segments(spark, path, before=batch_id)
    added = write_segment(df.withColumn("batch_id", F.lit(batch_id).cast("long")), path, batch_id, batch_id, partition_by)
    return commit(spark, path, batch_id, [*listed, added])


def read(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The table in its newest version, with ``batch_id``; with ``before`` as it was before that batch. Empty if there is none."""
    return read_segments(spark, path, schema, segments(spark, path, before))


def replace(df: DataFrame, path: str, batch_id: int) -> bool:
    """The rows as the whole content of the table from this batch on; nothing happens if the batch is in it already."""
    if committed(df.sparkSession, path, batch_id):
        return False
    rows = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
    return commit(df.sparkSession, path, batch_id, [write_segment(rows, path, batch_id, batch_id)])


def to_merge(listed: list[Segment]) -> int:
    """How many of the newest folders to put together: all that are no larger than what is newer than them."""
    count, held = 1, listed[-1].bytes if listed else 0
    for older in reversed(listed[:-1]):
        if older.bytes > held and len(listed) - count < FANOUT:
            break
        held += older.bytes
        count += 1
    return count


def compact(spark: SparkSession, path: str, schema: T.StructType, partition_by: tuple[str, ...] = (), fanout: int = FANOUT) -> int:
    """Merges small folders if there are more than ``fanout``; returns how many it merged.

    It commits a further step of the newest batch. A batch that is written meanwhile goes on from the version it has
    read, and the merge is simply not used.
    """
    known = versions(spark, path)
    listed = segments(spark, path)
    if len(listed) <= fanout:
        return 0
    batch_id, step = map(int, known[-1].removesuffix(".json").split("-"))
    count = to_merge(listed)
    if count < 2:
        return 0
    old, new = listed[:-count], listed[-count:]
    merged = write_segment(read_segments(spark, path, schema, new), path, new[0].first, new[-1].last, partition_by)
    return count if commit(spark, path, batch_id, [*old, merged], step + 1) else 0


def unlisted(spark: SparkSession, path: str, since: int) -> list[str]:
    """Data folders that the manifests of batch ``since`` and later do not list and that hold no later batch."""
    needed = set()
    for name in versions(spark, path):
        if name >= version_name(since):
            needed |= {s["folder"] for s in json.loads(get_text(spark, f"{path}/manifest/{name}"))}
    return [f"data/{n}" for n in names_in(spark, f"{path}/data") if f"data/{n}" not in needed and int(n.split("-")[1]) < since]


# ---- partitions that replace each other ------------------------------------------

def read_partitions(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> DataFrame:
    """Of each partition the newest version: every folder says which partitions it holds, and the last one to hold a
    partition has it as it is now. Replaced ones are pruned."""
    listed = segments(spark, path)
    if not listed:
        return spark.createDataFrame([], schema)

    def stored(kind: str, fields: list[T.StructField]) -> DataFrame:
        full = T.StructType([*fields, T.StructField("version", T.LongType())])
        return spark.read.schema(full).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/{s.folder}" for s in listed])

    newest = stored("held", [schema[partition]]).groupBy(partition).agg(F.max("version").alias("version"))
    rows = stored("data", list(schema))
    return rows.join(newest, [partition, "version"], "left_semi").select(*schema.names)


def replace_partitions(df: DataFrame, path: str, partition: str, touched: DataFrame) -> int:
    """Writes new versions of the partitions in ``touched`` (also of those without rows now); returns the version."""
    spark = df.sparkSession
    known = versions(spark, path)
    version = int(known[-1].split("-")[0]) + 1 if known else 0
    folder = f"version={version}"
    static = {"partitionOverwriteMode": "static"}
    touched.select(partition).distinct().write.mode("overwrite").options(**static).parquet(f"{path}/held/{folder}")
    df.hint("rebalance", partition).write.mode("overwrite").options(**static).partitionBy(partition).parquet(f"{path}/data/{folder}")
    listed = [*segments(spark, path), Segment(folder, version, version, size_of(spark, f"{path}/data/{folder}"))]
    if not commit(spark, path, version, listed):
        raise RuntimeError(f"another writer made version {version} of {path}")
    return version
