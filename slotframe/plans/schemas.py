"""Table schemas derived from interface definitions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.names import sanitize_name
from slotframe.plans.types import Interface, Layout, describe, parse_interface, spark_type


TYPES = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "BINARY": T.BinaryType(), "VARIANT": T.VariantType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """Schema from ``name TYPE, ...`` without needing a session."""
    pairs = [column.split() for column in text.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


TRANSACTIONS = _schema(
    "signature STRING, slot BIGINT, block_time TIMESTAMP, success BOOLEAN, fee BIGINT, "
    "err_msg STRING, indexed_at TIMESTAMP")
INSTRUCTIONS = _schema(
    "transaction_signature STRING, slot BIGINT, outer_index INT, inner_index INT, instruction_index INT, "
    "instruction_name STRING, program_id STRING, args VARIANT, accounts ARRAY<STRING>, "
    "raw_data BINARY, decode_status STRING, indexed_at TIMESTAMP")
SYNC_STATE = _schema(
    "program_id STRING, last_slot BIGINT, last_signature STRING, updated_at TIMESTAMP")
CORE_TABLES = {"sync_state": SYNC_STATE, "transactions": TRANSACTIONS, "instructions": INSTRUCTIONS}

ACCOUNT_HEAD = _schema("pubkey BINARY, slot BIGINT, transaction_signature STRING, data VARIANT")
ACCOUNT_TAIL = _schema("source STRING, observed_at TIMESTAMP, indexed_at TIMESTAMP")
INSTRUCTION_HEAD = _schema(
    "transaction_signature STRING, outer_index INT, inner_index INT, instruction_index INT")
INSTRUCTION_TAIL = _schema("indexed_at TIMESTAMP")


def table_name(layout: Layout) -> str:
    middle = "_ix_" if layout.kind == "instruction" else "_"
    return sanitize_name(f"{layout.program}{middle}{layout.name}")


def column_names(layout: Layout) -> dict[int, str]:
    """Column name per field position; a name already taken gets ``_1``, ``_2``, ..."""
    head, tail = _frame(layout)
    taken = {f.name for f in head} | {f.name for f in tail}
    names = {}
    for i, (field, _) in enumerate(layout.fields):
        base = name = sanitize_name(field)
        step = 0
        while name in taken:
            step += 1
            name = f"{base}_{step}"
        taken.add(name)
        names[i] = name
    return names


def _frame(layout: Layout) -> tuple[T.StructType, T.StructType]:
    if layout.kind == "instruction":
        return INSTRUCTION_HEAD, INSTRUCTION_TAIL
    return ACCOUNT_HEAD, ACCOUNT_TAIL


def typed_schema(layout: Layout) -> T.StructType:
    """Schema of the table that holds one instruction or account type."""
    head, tail = _frame(layout)
    names = column_names(layout)
    typed = [T.StructField(names[i], spark_type(node)) for i, (_, node) in enumerate(layout.fields)]
    return T.StructType([*head, *typed, *tail])


def account_schema(interface: Interface, account: str) -> T.StructType:
    return typed_schema(interface.find("account", account))


def instruction_schema(interface: Interface, instruction: str) -> T.StructType:
    return typed_schema(interface.find("instruction", instruction))


def derive_schemas(interface: Interface) -> dict[str, T.StructType]:
    """Every table of one definition."""
    derived = {table_name(x): typed_schema(x) for x in (*interface.instructions, *interface.accounts)}
    return {**CORE_TABLES, **derived}


SCHEMA_ROWS = "program_id STRING, table_name STRING, ordinal INT, column_name STRING, column_type STRING"


TASKS_PER_CORE = 4


def _columns_of(schema: T.StructType) -> tuple[list[int], list[str], list[str]]:
    return list(range(len(schema))), schema.names, [f.dataType.simpleString() for f in schema]


def schema_table(documents: DataFrame) -> DataFrame:
    """Schemas of many definitions as rows, from (program_id, json); one task row per definition.

    Definitions take much longer to read than their bytes let Spark expect, so they are dealt out to all cores first.
    """
    core = {table: _columns_of(schema) for table, schema in CORE_TABLES.items()}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {f.name: [] for f in _schema(SCHEMA_ROWS)}
            for key, document in zip(batch["program_id"], batch["json"]):
                for table, schema in derive_schemas(parse_interface(document, key)).items():
                    found = core[table] if schema is CORE_TABLES.get(table) else _columns_of(schema)
                    own = ([key] * len(schema), [table] * len(schema), *found)
                    for column, values in zip(out.values(), own):
                        column += values
            yield pd.DataFrame(out)

    tasks = TASKS_PER_CORE * documents.sparkSession.sparkContext.defaultParallelism
    return documents.select("program_id", "json").repartition(tasks).mapInPandas(rows, SCHEMA_ROWS)


@F.pandas_udf(T.StringType())
def _type_name(described: pd.Series) -> pd.Series:
    def name(text: str) -> str:
        value = json.loads(text) if text[:1] in "{[\"" else text
        return spark_type(describe(value)).simpleString()

    return described.map(name, na_action="ignore")


def type_name(described: Column) -> Column:
    """Spark type of an interface type given as text or JSON (no types of its own behind it)."""
    return _type_name(described)


def empty_tables(spark, interface: Interface) -> dict[str, DataFrame]:
    """Every derived table, empty: what a program looks like before its first record."""
    return {name: spark.createDataFrame([], schema) for name, schema in derive_schemas(interface).items()}
