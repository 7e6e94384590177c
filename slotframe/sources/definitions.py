"""Interface definitions: from JSON files or from compressed account blobs, many at once."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.base58 import unbase58
from slotframe.functions.names import account_discriminator, instruction_discriminator
from slotframe.plans.layout import fence
from slotframe.plans.types import Interface, parse_interface

# Header, authority and length in front of a compressed definition.
AUTHORITY_AT, LENGTH_AT, BODY_AT = 8, 40, 44

# Types nest without limit, so they stay JSON text here.
DOCUMENT = (
    "address STRING, name STRING, "
    "metadata STRUCT<name STRING, version STRING, spec STRING, address STRING>, "
    "instructions ARRAY<STRUCT<name STRING, discriminator ARRAY<INT>, "
    "accounts ARRAY<STRUCT<name STRING, writable BOOLEAN, signer BOOLEAN, optional BOOLEAN, isMut BOOLEAN>>, "
    "args STRING>>, "
    "accounts ARRAY<STRUCT<name STRING, discriminator ARRAY<INT>, type STRING>>, "
    "types ARRAY<STRUCT<name STRING, type STRING>>")


@dataclass(frozen=True)
class Registry:
    """Definitions as tables. ``documents`` keeps the JSON, the others have one row per item."""
    documents: DataFrame
    instructions: DataFrame
    accounts: DataFrame
    types: DataFrame
    rejected: DataFrame

    def interface(self, program_id: str) -> Interface:
        """The type tree of one program, for building decode plans on the driver."""
        found = self.documents.where(F.col("program_id") == program_id).select("json").limit(1).collect()
        if not found:
            raise KeyError(f"no definition for program {program_id!r}")
        return parse_interface(found[0]["json"], program_id)


def read_definition_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, json), one row per file."""
    return (spark.read.text(path_glob, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def _inflate(blob: bytes | None) -> tuple[str | None, str | None]:
    if blob is None or len(blob) <= BODY_AT:
        return None, "too short"
    size = int.from_bytes(blob[LENGTH_AT:BODY_AT], "little")
    stream = zlib.decompressobj()
    try:
        text = stream.decompress(blob[BODY_AT:BODY_AT + size])  # a slice stops at the end by itself
        return (text.decode("utf-8"), None) if stream.eof else (None, "incomplete")
    except zlib.error:
        return None, "not zlib"
    except UnicodeDecodeError:
        return None, "not text"


@F.arrow_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _inflate_blobs(blobs: pa.Array) -> pa.Array:
    texts, errors = zip(*[_inflate(b) for b in blobs.to_pylist()]) if len(blobs) else ((), ())
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                                      ["json", "error"])


def inflate_definitions(blobs: DataFrame) -> DataFrame:
    """(program_id, json, error) from account blobs. ``error`` is set where the blob is no good."""
    return (fence(blobs.select("program_id", _inflate_blobs("data").alias("r")), "r")
            .select("program_id", "r.json", "r.error"))


def _bytes_of(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0")), ""))


def _or_computed(numbers: Column, computed: Column) -> Column:
    return F.when(F.size(numbers) > 0, _bytes_of(numbers)).otherwise(computed)


def by_key_bytes(definitions: DataFrame) -> DataFrame:
    """Instruction or account definitions with the program id as key bytes, to match raw records."""
    return definitions.withColumn("program_id", unbase58(F.col("program_id")))


def build_registry(documents: DataFrame) -> Registry:
    """Registry tables from (json [, program_id]) rows; one narrow pass, no shuffle.

    Definitions without a name or without instructions are rejected, not dropped.
    """
    doc = F.col("doc")
    given = F.col("program_id") if "program_id" in documents.columns else F.lit(None).cast("string")
    parsed = (documents.withColumn("doc", F.from_json("json", DOCUMENT))
              .withColumn("program", F.coalesce(doc["metadata"]["name"], doc["name"]))
              .withColumn("program_id", F.coalesce(given, doc["address"], doc["metadata"]["address"],
                                                   F.col("program"))))
    usable = F.col("program").isNotNull() & doc["instructions"].isNotNull()
    good = parsed.where(usable)
    key = ["program_id", "program"]

    ix = F.col("ix")
    writable = F.filter(
        F.transform(ix["accounts"], lambda a, i: F.when(F.coalesce(a["writable"], a["isMut"], F.lit(False)), i)),
        lambda i: i.isNotNull())
    instructions = (good.select(*key, F.posexplode(doc["instructions"]).alias("ordinal", "ix")).select(
        *key, "ordinal", ix["name"].alias("name"),
        _or_computed(ix["discriminator"], instruction_discriminator(ix["name"])).alias("discriminator"),
        F.coalesce(ix["args"], F.lit("[]")).alias("fields"),
        F.coalesce(writable, F.array().cast("array<int>")).alias("writable_positions")))

    # The first type of the account's name counts, and only if it is a struct.
    account, body = F.col("a"), F.col("body")
    first_type = F.transform(doc["accounts"], lambda a: F.struct(
        a.alias("a"), F.get(F.filter(doc["types"], lambda t: t["name"] == a["name"]), 0)["type"].alias("t")))
    accounts = (good.select(*key, F.posexplode(first_type).alias("ordinal", "pair"))
                .select(*key, "ordinal", "pair.a", F.coalesce("pair.t", "pair.a.type").alias("body"))
                .select(*key, "ordinal", account["name"].alias("name"),
                        _or_computed(account["discriminator"],
                                     account_discriminator(account["name"])).alias("discriminator"),
                        F.when(F.get_json_object(body, "$.kind") == "struct",
                               F.coalesce(F.get_json_object(body, "$.fields"), F.lit("[]"))).alias("fields")))

    types = (good.select(*key, F.posexplode(doc["types"]).alias("ordinal", "t"))
             .select(*key, "ordinal", "t.name", "t.type"))
    return Registry(good.select(*key, "json"), instructions, accounts, types,
                    parsed.where(~usable).select("program_id", "json"))


def load_registry(spark: SparkSession, path_glob: str) -> Registry:
    return build_registry(read_definition_files(spark, path_glob))


def load_registry_blobs(blobs: DataFrame) -> Registry:
    """Registry from (program_id, data) blobs; unusable ones show up in ``rejected``."""
    return build_registry(inflate_definitions(blobs).select("program_id", "json"))


def resolve_types(types: DataFrame) -> DataFrame:
    """One row per (program, type name): of several the last one counts."""
    return types.groupBy("program_id", "name").agg(F.max_by("type", "ordinal").alias("type"))


def odd_discriminators(registry: Registry) -> DataFrame:
    """Definitions whose discriminator is not eight bytes long; nothing ever matches them."""
    columns = ["program_id", "name", "discriminator"]
    both = registry.instructions.select(*columns).unionByName(registry.accounts.select(*columns))
    return both.where(F.length("discriminator") != 8)
