"""Matches payloads with definitions by their first eight bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.base58 import key_bytes
from slotframe.functions.names import DISCRIMINATOR_BYTES
from slotframe.plans.types import Interface

UNKNOWN_NAME = "unknown"
BROADCAST_BYTES = 4 << 20
SALTS = 32


def prefix(data: Column) -> Column:
    """The discriminator of a payload; NULL when it is shorter than that."""
    return F.when(F.length(data) >= DISCRIMINATOR_BYTES, F.substring(data, 1, DISCRIMINATOR_BYTES))


def first_definitions(definitions: DataFrame) -> DataFrame:
    """One definition per (program, discriminator): the first in order. Other lengths never match."""
    rest = [c for c in definitions.columns if c not in ("program_id", "discriminator", "ordinal")]
    return (definitions.where(F.length("discriminator") == DISCRIMINATOR_BYTES)
            .groupBy("program_id", "discriminator")
            .agg(F.min_by(F.struct(*rest), "ordinal").alias("d"))
            .select("program_id", "discriminator", "d.*"))


def attach_small(facts: DataFrame, small: DataFrame, on: list[str], bytes_limit: int = BROADCAST_BYTES,
                 known_bytes: int | None = None) -> DataFrame:
    """Left join with a lookup table that has one row per key.

    The lookup's size in bytes is added up first, unless it is known. Within the
    limit it is broadcast, so the facts are not shuffled. Beyond it the lookup is
    copied ``SALTS`` times and the facts are spread over the copies by a hash of the
    whole row, so no single key fills one task. The hint keeps Spark, which goes by the
    size of files that may be compressed many times, from broadcasting the copies.
    """
    size = known_bytes
    if size is None:
        size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))).alias("n")).first()["n"] or 0
    if size <= bytes_limit:
        return facts.join(F.broadcast(small), on, "left")
    hashed = [f.name for f in facts.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return facts.withColumn("_salt", spread).join(copies.hint("merge"), [*on, "_salt"], "left").drop("_salt")


def definition_rows(df: DataFrame, interfaces: list[Interface], kind: str) -> DataFrame:
    """Definitions held by the driver as a lookup table, first per discriminator, keyed like ``df``."""
    as_bytes = isinstance(df.schema["program_id"].dataType, T.BinaryType)
    first: dict[tuple, tuple] = {}
    for face in interfaces:
        key = key_bytes(face.program_id) if as_bytes else face.program_id
        for x in face.layouts(kind):
            if len(x.discriminator) == DISCRIMINATOR_BYTES:
                first.setdefault((key, x.discriminator), (x.program, x.name, list(x.writable)))
    schema = T.StructType([
        T.StructField("program_id", df.schema["program_id"].dataType),
        T.StructField("discriminator", T.BinaryType()), T.StructField("program", T.StringType()),
        T.StructField("name", T.StringType()), T.StructField("writable_positions", T.ArrayType(T.IntegerType()))])
    return df.sparkSession.createDataFrame([(*k, *v) for k, v in first.items()], schema)


def dispatch(df: DataFrame, definitions: DataFrame | list[Interface], kind: str = "instruction",
             data: str = "data", bytes_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Adds the columns of the matching definition and ``matched``; nothing matches a short payload.

    ``definitions`` is the instruction or account table of a registry, or a list of
    interfaces (then ``kind`` says which of the two). Rows without a match keep their
    bytes and are named ``unknown``. The fields of a definition may be of any length and
    are not joined.
    """
    if isinstance(definitions, DataFrame):
        known, size = first_definitions(definitions.drop("fields")), None
    else:
        known = definition_rows(df, definitions, kind)
        size = sum(200 + 4 * len(x.name) + 4 * len(x.program) + 4 * len(x.writable)
                   for face in definitions for x in face.layouts(kind))
    known = known.withColumnRenamed("discriminator", "_prefix").withColumn("matched", F.lit(True))
    keyed = df.withColumn("_prefix", prefix(F.col(data)))
    joined = attach_small(keyed, known, ["program_id", "_prefix"], bytes_limit, known_bytes=size)
    return (joined.drop("_prefix")
            .withColumn("matched", F.coalesce("matched", F.lit(False)))
            .withColumn("name", F.coalesce("name", F.lit(UNKNOWN_NAME))))
