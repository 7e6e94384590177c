"""Scans of landed ledger records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.operators.tables import slot_bucket


def scan_slots(raw: DataFrame, start: int, end: int) -> DataFrame:
    """Records with ``start <= slot <= end``; prunes slot-bucket partitions where the table has them."""
    if start > end:
        raise ValueError(f"start slot {start} is after end slot {end}")
    rows = raw.where(F.col("slot").between(start, end))
    if "slot_bucket" in raw.columns:
        rows = rows.where(F.col("slot_bucket").between(slot_bucket(F.lit(start)), slot_bucket(F.lit(end))))
    return rows


def lookup_signatures(raw: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found records, signatures that were not found).

    The record table is only ever semi-joined with the list, which Spark broadcasts
    when it is small; what is missing follows from the much smaller result.
    """
    wanted = signatures.select("signature").distinct()
    found = raw.join(wanted, "signature", "left_semi")
    return found, wanted.join(found.select("signature"), "signature", "left_anti")


def _after(position: tuple, columns: list[str]) -> Column:
    """Row position > ``position``, column by column."""
    later = F.lit(False)
    for name, value in reversed(list(zip(columns, position))):
        later = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & later)
    return later


def _before(position: tuple, columns: list[str]) -> Column:
    earlier = F.lit(False)
    for name, value in reversed(list(zip(columns, position))):
        earlier = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & earlier)
    return earlier


def backfill(raw: DataFrame, since: tuple | None, order: tuple[str, ...] = ("slot", "signature"),
             oldest_first: bool = False) -> DataFrame:
    """Everything after a checkpoint position. Sort only where the consumer needs the order."""
    columns = list(order)
    rows = raw
    if since is not None:
        # The plain comparison is implied; it is there because it reaches the scan.
        rows = raw.where(F.col(columns[0]) >= F.lit(since[0])).where(_after(since, columns))
    return rows.orderBy(*columns) if oldest_first else rows


def keyset_page(df: DataFrame, limit: int, before: tuple | None = None, until: tuple | None = None,
                order: tuple[str, ...] = ("slot", "signature")) -> DataFrame:
    """Newest first, strictly before ``before`` and strictly after ``until``. Deep pages cost no more than the first."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    columns = list(order)
    rows = df
    if before is not None:
        rows = rows.where(F.col(columns[0]) <= F.lit(before[0])).where(_before(before, columns))
    if until is not None:
        rows = rows.where(F.col(columns[0]) >= F.lit(until[0])).where(_after(until, columns))
    return rows.orderBy(*[F.col(c).desc() for c in columns]).limit(limit)


def _members(df: DataFrame, column: str, keys: list | DataFrame, key_column: str) -> DataFrame:
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(key_column).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def scan_accounts(raw_accounts: DataFrame, program_ids: list | DataFrame) -> DataFrame:
    """Accounts owned by the given programs. A list becomes a pushed-down filter, a table a semi join."""
    return _members(raw_accounts, "owner", program_ids, "program_id")


def for_programs(instructions: DataFrame, program_ids: list | DataFrame) -> DataFrame:
    """Instructions of the given programs."""
    return _members(instructions, "program_id", program_ids, "program_id")
