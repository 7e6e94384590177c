"""From raw transactions to transaction rows and flat instruction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.base58 import unbase58
from slotframe.functions.times import narrow_long, unix_time

NESTED_STEP = 1000  # fixed value: combined index = outer * 1000 + inner


def to_transactions(raw: DataFrame, indexed_at: Column | None = None) -> DataFrame:
    """Transaction rows. No error, or no metadata at all, means success."""
    return raw.select(
        "signature", narrow_long(F.col("slot")).alias("slot"),
        unix_time(F.col("block_time")).alias("block_time"),
        F.col("err").isNull().alias("success"),
        narrow_long(F.col("fee")).alias("fee"),
        F.col("err").alias("err_msg"),
        (F.current_timestamp() if indexed_at is None else indexed_at).alias("indexed_at"))


def overflowed(raw: DataFrame) -> DataFrame:
    """Records whose slot or fee does not fit a signed 64-bit column."""
    lost = [F.col(c).isNotNull() & narrow_long(F.col(c)).isNull() for c in ("slot", "fee")]
    return raw.where(lost[0] | lost[1])


def _inner_is_text(df: DataFrame) -> bool:
    if "inner" not in df.columns:
        return False
    item = df.schema["inner"].dataType.elementType["instructions"].dataType.elementType
    return isinstance(item["data"].dataType, T.StringType)


def instruction_array(df: DataFrame, compact: bool = False) -> Column:
    """All instructions of a transaction in execution order, as one array built inside the row.

    Each top-level instruction is followed by those it called. Indices outside the
    key list give NULL: a NULL program matches nothing, a NULL account keeps the
    positions of the others (``compact`` drops it instead).
    """
    message = F.col("message")
    keys = message["account_keys"]
    if "loaded_keys" in df.columns:
        keys = F.concat(keys, F.coalesce("loaded_keys", F.array().cast("array<binary>")))
    inner_text = _inner_is_text(df)

    def accounts(indices: Column) -> Column:
        found = F.transform(indices, lambda i: F.get(keys, i))
        return F.filter(found, lambda k: k.isNotNull()) if compact else found

    def row(ix: Column, outer: Column, inner: Column | None) -> Column:
        nested = inner is not None
        data = F.lit(None).cast("binary") if nested and inner_text else ix["data"]
        text = ix["data"] if nested and inner_text else F.lit(None).cast("string")
        return F.struct(
            outer.cast("int").alias("outer_index"),
            (inner if nested else F.lit(None)).cast("int").alias("inner_index"),
            (outer * NESTED_STEP + inner if nested else outer).cast("int").alias("instruction_index"),
            F.get(keys, ix["program_index"]).alias("program_id"),
            accounts(ix["account_indices"]).alias("accounts"),
            data.alias("data"), *([text.alias("data_text")] if inner_text else []))

    def with_called(ix: Column, outer: Column) -> Column:
        own = F.array(row(ix, outer, None))
        if "inner" not in df.columns:
            return own
        called = F.get(F.filter("inner", lambda s: s["outer_index"] == outer), 0)["instructions"]
        nested = F.transform(called, lambda c, k: row(c, outer, k))
        return F.when(called.isNull(), own).otherwise(F.concat(own, nested))

    return F.flatten(F.transform(message["instructions"], with_called))


def flatten_instructions(messages: DataFrame, keep: tuple[str, ...] = ("slot",), compact: bool = False) -> DataFrame:
    """One row per instruction, keyed by (transaction_signature, outer_index, inner_index); one explode."""
    rows = messages.select(F.col("signature").alias("transaction_signature"), *keep,
                           F.explode(instruction_array(messages, compact)).alias("ix"))
    flat = rows.select("transaction_signature", *keep, "ix.*")
    if "data_text" in flat.columns:
        decoded = F.coalesce("data", unbase58(F.col("data_text")), F.lit(b""))
        flat = flat.withColumn("data", decoded).drop("data_text")
    return flat


def touched_accounts(dispatched: DataFrame) -> DataFrame:
    """One row per writable account of a matched instruction.

    Expects ``accounts`` and the ``writable_positions`` of the matching definition.
    """
    keys = F.transform("writable_positions", lambda p: F.get(F.col("accounts"), p))
    found = F.filter(keys, lambda k: k.isNotNull())
    return dispatched.where("matched").select(
        "transaction_signature", "slot", "outer_index", "inner_index", "program_id",
        F.explode(found).alias("pubkey"))


def nested_ledger(messages: DataFrame, indexed_at: Column | None = None) -> DataFrame:
    """One row per transaction with all its instructions, so that both are committed together."""
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    return messages.select(
        "signature", narrow_long(F.col("slot")).alias("slot"),
        unix_time(F.col("block_time")).alias("block_time"), F.col("err").isNull().alias("success"),
        narrow_long(F.col("fee")).alias("fee"), F.col("err").alias("err_msg"),
        instruction_array(messages).alias("instructions"), stamp.alias("indexed_at"))


def ledger_transactions(nested: DataFrame) -> DataFrame:
    """The transactions table as a view of the nested one."""
    return nested.drop("instructions")


def ledger_instructions(nested: DataFrame) -> DataFrame:
    """The instructions table as a view of the nested one."""
    return (nested.select(F.col("signature").alias("transaction_signature"), "slot", "indexed_at",
                          F.explode("instructions").alias("ix"))
            .select("transaction_signature", "slot", "ix.*", "indexed_at"))
