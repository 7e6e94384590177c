"""The read queries: listings with pages, statistics, breakdown, time buckets, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.base58 import key_bytes
from slotframe.functions.times import period_start, time_bound

# The page size where none is asked for, and the limits that a service over these tables keeps.
DEFAULT_LIMIT, SERVICE_LIMIT, SERVICE_BUCKETS = 50, 500, 1000


def service_limit(limit: int | None) -> int:
    """The page size that the service gives for a request: never above SERVICE_LIMIT. ``page`` itself gives what is asked."""
    return min(DEFAULT_LIMIT if limit is None else limit, SERVICE_LIMIT)


def _newest_first(*names: str) -> list[Column]:
    return [F.col(n).desc() for n in names]


# Newest first, with every tie settled.
TRANSACTION_ORDER = ("slot", "signature")
INSTRUCTION_ORDER = ("slot", "transaction_signature", "outer_index", "inner_index")
ACCOUNT_ORDER = ("slot", "pubkey", "observed_at")


def _where(df: DataFrame, **tests: tuple[str, str, object]) -> DataFrame:
    for column, op, value in tests.values():
        if value is None:
            continue
        left, right = F.col(column), F.lit(value)
        df = df.where(left == right if op == "=" else left >= right if op == ">=" else left <= right)
    return df


def filter_transactions(df: DataFrame, signature: str | None = None, slot_from: int | None = None,
                        slot_to: int | None = None, success: bool | None = None) -> DataFrame:
    return _where(df, a=("signature", "=", signature), b=("slot", ">=", slot_from),
                  c=("slot", "<=", slot_to), d=("success", "=", success))


def filter_instructions(df: DataFrame, name: str | None = None, transaction_signature: str | None = None,
                        program_id: str | None = None, slot_from: int | None = None,
                        slot_to: int | None = None) -> DataFrame:
    """A slot range needs a ``slot`` column (see ``lookups.with_transaction``)."""
    return _where(df, a=("instruction_name", "=", name), b=("transaction_signature", "=", transaction_signature),
                  c=("program_id", "=", program_id), d=("slot", ">=", slot_from), e=("slot", "<=", slot_to))


def filter_accounts(tables: dict[str, DataFrame], account_type: str, pubkey: object = None,
                    slot_from: int | None = None, slot_to: int | None = None) -> DataFrame:
    """States of one account type; an unknown type is a KeyError. A base58 key finds BINARY keys too."""
    if account_type not in tables:
        raise KeyError(f"unknown account type {account_type!r}")
    states = tables[account_type]
    if isinstance(pubkey, str) and isinstance(states.schema["pubkey"].dataType, T.BinaryType):
        pubkey = key_bytes(pubkey)
    return _where(states, a=("pubkey", "=", pubkey), b=("slot", ">=", slot_from),
                  c=("slot", "<=", slot_to))


@dataclass(frozen=True)
class Page:
    """``data`` holds the rows; ``envelope`` one row (total, limit, offset, has_next)."""
    data: DataFrame
    envelope: DataFrame


def page(df: DataFrame, order: tuple[str, ...], limit: int | None = None, offset: int | None = None) -> Page:
    """One page of ``limit`` rows, newest first. For deep pages use ``sources.ledger.keyset_page``."""
    limit = DEFAULT_LIMIT if limit is None else limit
    offset = 0 if offset is None else offset
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    total = F.count("*")
    envelope = df.agg(total.alias("total")).select(
        "total", F.lit(limit).cast("bigint").alias("limit"), F.lit(offset).cast("bigint").alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_next"))
    return Page(df.orderBy(*_newest_first(*order)).offset(offset).limit(limit), envelope)


def stats(transactions: DataFrame, instructions: DataFrame, account_types: list[str] | None = None) -> DataFrame:
    """Totals in one row: one pass over each table, put together as a union of two partial rows.

    ``account_types`` adds the known account types as a column.
    """
    nothing = F.lit(0).cast("bigint")
    tx = transactions.agg(F.count("*").alias("total_transactions"),
                          F.count_if("success").alias("successful_transactions"),
                          F.max("slot").alias("latest_slot")).withColumn("total_instructions", nothing)
    ix = instructions.agg(F.count("*").alias("total_instructions")).select(
        nothing.alias("total_transactions"), nothing.alias("successful_transactions"),
        F.lit(None).cast("bigint").alias("latest_slot"), "total_instructions")
    both = tx.unionByName(ix).agg(
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("successful_transactions").alias("successful_transactions"),
        F.sum("total_instructions").alias("total_instructions"),
        F.max("latest_slot").alias("latest_slot"))
    failed = F.col("total_transactions") - F.col("successful_transactions")
    types = [] if account_types is None else [F.array(*map(F.lit, account_types)).alias("account_types")]
    return both.select("total_transactions", "successful_transactions",
                       failed.alias("failed_transactions"), "total_instructions", "latest_slot", *types)


def instruction_breakdown(instructions: DataFrame) -> DataFrame:
    """Instructions per name, most frequent first."""
    return (instructions.groupBy(F.col("instruction_name").alias("name")).agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), "name"))


def instruction_buckets(instructions: DataFrame, period: str | None = None, name: str | None = None,
                        from_time: str | None = None, to_time: str | None = None,
                        time_col: str = "indexed_at", limit: int | None = None) -> DataFrame:
    """Instructions per (hour or day, name), newest first; the time range includes both ends.

    All buckets, unless ``limit`` asks for the newest ones only.
    """
    rows = _where(instructions, a=("instruction_name", "=", name))
    if from_time is not None:
        rows = rows.where(F.col(time_col) >= time_bound(from_time))
    if to_time is not None:
        rows = rows.where(F.col(time_col) <= time_bound(to_time))
    buckets = (rows.groupBy(period_start(period, F.col(time_col)).alias("period"), "instruction_name")
               .agg(F.count("*").alias("count")).orderBy(F.col("period").desc(), "instruction_name"))
    return buckets if limit is None else buckets.limit(limit)


# Metric names and their help texts.
METRICS = (("indexer_transactions_total", "Total indexed transactions", "total_transactions"),
           ("indexer_instructions_total", "Total indexed instructions", "total_instructions"),
           ("indexer_latest_slot", "Latest indexed slot", "latest_slot"))


def metrics(transactions: DataFrame, instructions: DataFrame) -> DataFrame:
    """The three data gauges, each also in text exposition form (``rendered``)."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("help"),
                               F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("value"))
                      for n, h, c in METRICS])
    rows = stats(transactions, instructions).select(F.inline(cells))
    text = F.format_string("# HELP %s %s\n# TYPE %s gauge\n%s %d\n", "name", "help", "name", "name", "value")
    return rows.select("name", "help", F.lit("gauge").alias("type"), "value", text.alias("rendered"))


def ingest_report(batch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records per outcome of a run; failures are counted apart."""
    return batch.groupBy(*by, "status").agg(F.count("*").alias("records"))
