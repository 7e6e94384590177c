"""Unpacks transactions that landed as wire bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.wire import base64_bytes
from slotframe.plans.layout import fence

# Sizes in the wire format.
SIGNATURE_BYTES, KEY_BYTES, HEADER_BYTES, VERSION_BIT = 64, 32, 3, 0x80

INSTRUCTION = T.StructType([
    T.StructField("program_index", T.IntegerType()),
    T.StructField("account_indices", T.ArrayType(T.IntegerType())),
    T.StructField("data", T.BinaryType())])
MESSAGE = T.StructType([
    T.StructField("account_keys", T.ArrayType(T.BinaryType())),
    T.StructField("instructions", T.ArrayType(INSTRUCTION))])
_ARROW_INSTRUCTION = pa.struct([("program_index", pa.int32()), ("account_indices", pa.list_(pa.int32())),
                                ("data", pa.binary())])
_ARROW_MESSAGE = pa.struct([("account_keys", pa.list_(pa.binary())),
                            ("instructions", pa.list_(_ARROW_INSTRUCTION))])


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.raw):
            raise ValueError("message ends early")
        self.at += size
        return self.raw[self.at - size:self.at]

    def count(self) -> int:
        """A compact length: seven bits per byte, at most 65535, no padding bytes."""
        value = 0
        for i in range(3):
            byte = self.take(1)[0]
            if i and byte == 0:
                raise ValueError("padded length")
            value |= (byte & 0x7F) << (7 * i)
            if not byte & 0x80:
                break
        else:
            raise ValueError("length too long")
        if value > 0xFFFF:
            raise ValueError("length too large")
        return value


def parse_message(raw: bytes | None) -> dict | None:
    """Account keys and instructions of one transaction, None when the bytes are no transaction."""
    if raw is None:
        return None
    cursor = _Cursor(raw)
    try:
        cursor.take(SIGNATURE_BYTES * cursor.count())
        versioned = cursor.take(1)[0]
        if versioned & VERSION_BIT:
            if versioned != VERSION_BIT:
                return None
            cursor.take(HEADER_BYTES)
        else:
            cursor.take(HEADER_BYTES - 1)
        keys = [cursor.take(KEY_BYTES) for _ in range(cursor.count())]
        cursor.take(KEY_BYTES)
        instructions = [{"program_index": cursor.take(1)[0],
                         "account_indices": list(cursor.take(cursor.count())),
                         "data": cursor.take(cursor.count())} for _ in range(cursor.count())]
        if versioned & VERSION_BIT:
            for _ in range(cursor.count()):  # looked-up keys: must be well formed, are not resolved here
                cursor.take(KEY_BYTES)
                cursor.take(cursor.count())
                cursor.take(cursor.count())
    except ValueError:
        return None
    return {"account_keys": keys, "instructions": instructions}


@F.arrow_udf(MESSAGE)
def _parse_messages(raw: pa.Array) -> pa.Array:
    return pa.array([parse_message(r) for r in raw.to_pylist()], _ARROW_MESSAGE)


def unpack_messages(raw: DataFrame, column: str = "wire_base64") -> DataFrame:
    """Replaces the base64 column by ``message`` and ``unpack_status``.

    A record whose bytes cannot be read keeps its row, without instructions.
    """
    kept = [c for c in raw.columns if c != column]
    wire = raw.withColumn("_wire", base64_bytes(F.col(column)))
    parsed = fence(wire.withColumn("message", _parse_messages("_wire")), "_wire", "message")
    status = (F.when(F.col(column).isNull(), "missing").when(F.col("_wire").isNull(), "bad_base64")
              .when(F.col("message").isNull(), "bad_message").otherwise("ok"))
    return parsed.select(*kept, "message", status.alias("unpack_status"))
