"""Joins between ledger tables, and account states at a slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotframe.operators.skew import join_counted
from slotframe.operators.tables import latest_by

BLOCK_SLOTS = 4096


def with_transaction(instructions: DataFrame, transactions: DataFrame, slot_from: int | None = None,
                     slot_to: int | None = None) -> DataFrame:
    """Instructions with the columns of their transaction; the slot range reaches both scans.

    An instruction has its transaction's slot, which is the one that is returned. A transaction is one
    row, so a transaction with very many instructions can be split over tasks by the adaptive skew join.
    """
    def in_range(df: DataFrame) -> DataFrame:
        df = df if slot_from is None else df.where(F.col("slot") >= slot_from)
        return df if slot_to is None else df.where(F.col("slot") <= slot_to)

    tx = in_range(transactions)
    if "slot" in instructions.columns:
        instructions = in_range(instructions).drop("slot")
    return instructions.join(tx.withColumnRenamed("signature", "transaction_signature"), "transaction_signature")


def orphans(instructions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Instructions whose transaction is not stored."""
    known = transactions.select(F.col("signature").alias("transaction_signature"))
    return instructions.join(known, "transaction_signature", "left_anti")


def latest_accounts(states: DataFrame, key: tuple[str, ...] = ("program", "account_type", "pubkey"),
                    order: tuple[str, ...] = ("observed_at", "slot")) -> DataFrame:
    """The current state of every account. Older states are left out before anything is sorted; ties are settled by all columns."""
    return latest_by(states, list(key), list(order))


def account_state_at(touched: DataFrame, states: DataFrame, mode: str = "asof") -> DataFrame:
    """Touched accounts with their state; accounts without one are left out.

    ``latest`` gives the present state, ``asof`` the last one at or before the
    slot of the touch. States need (pubkey, slot, ...), touches (pubkey, slot, ...).
    """
    if mode == "latest":
        now = latest_accounts(states, ("pubkey",), ("slot",)).withColumnRenamed("slot", "state_slot")
        touches = touched.groupBy("pubkey").agg(F.count("*").alias("_touches"))
        known = now.withColumn("_found", F.lit(True)).join(touches, "pubkey")
        # An account of which there are very many touches is dealt out; each side is reduced before it is joined.
        rows = join_counted(touched, known, "pubkey", "_touches", touched.count(), F.col("slot"))
        return rows.where("_found").drop("_found")
    if mode != "asof":
        raise ValueError("mode must be 'asof' or 'latest'")
    versions = latest_accounts(states, ("pubkey", "slot"), ())
    probes = touched.select("pubkey", "slot").distinct()
    chosen = _version_at(probes, versions.select("pubkey", "slot"))
    return (touched.join(chosen, ["pubkey", "slot"])
            .join(versions.withColumnRenamed("slot", "state_slot"), ["pubkey", "state_slot"]))


def _version_at(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """(pubkey, slot, state_slot): the newest version slot at or before each probe slot.

    Works on distinct (pubkey, slot) pairs in blocks of ``BLOCK_SLOTS`` slots, so a
    window never holds more than two rows per slot of a block, however busy the
    account. What was known before a block comes from the per-block maxima.
    """
    block = F.floor(F.col("slot") / BLOCK_SLOTS).alias("block")
    both = (versions.select("pubkey", "slot", F.col("slot").alias("version"), F.lit(0).alias("side"))
            .unionByName(probes.select("pubkey", "slot", F.lit(None).cast("bigint").alias("version"),
                                       F.lit(1).alias("side")))
            .select("*", block))
    per_block = both.groupBy("pubkey", "block").agg(F.max("version").alias("newest"))
    earlier = Window.partitionBy("pubkey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select("pubkey", "block", F.max("newest").over(earlier).alias("carried"))
    inside = (Window.partitionBy("pubkey", "block").orderBy("slot", "side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumn("seen", F.max("version").over(inside)).where("side = 1")
    return (seen.join(carried, ["pubkey", "block"])
            .select("pubkey", "slot", F.coalesce("seen", "carried").alias("state_slot"))
            .where(F.col("state_slot").isNotNull()))
