"""base58 text of BINARY columns, vectorised over Arrow batches.

Spark has no built-in for it. Values of one length are handled together: the
numbers are rows of 32-bit limbs, and each step divides or multiplies a whole
column of limbs by 58**5 at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_CHARS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_DIGITS = np.full(256, -1, dtype=np.int64)
_DIGITS[_CHARS] = np.arange(58)
_GROUP = 58 ** 5


def _encode_equal(rows: np.ndarray) -> list[str]:
    """Encode a (count, length) byte matrix."""
    count, length = rows.shape
    pad = -length % 4
    padded = np.concatenate([np.zeros((count, pad), np.uint8), rows], axis=1)
    limbs = padded.view(">u4").astype(np.uint64)
    groups = int(np.ceil(length * 8 / np.log2(58) / 5)) + 1
    digits = np.empty((count, groups * 5), dtype=np.uint8)
    for group in range(groups - 1, -1, -1):
        rest = np.zeros(count, np.uint64)
        for i in range(limbs.shape[1]):
            value = (rest << np.uint64(32)) | limbs[:, i]
            limbs[:, i] = value // np.uint64(_GROUP)
            rest = value % np.uint64(_GROUP)
        for place in range(4, -1, -1):
            digits[:, group * 5 + place] = rest % np.uint64(58)
            rest = rest // np.uint64(58)
    zeros = np.where((rows != 0).any(axis=1), (rows != 0).argmax(axis=1), length)
    starts = np.where((digits != 0).any(axis=1), (digits != 0).argmax(axis=1), digits.shape[1])
    text = _CHARS[digits].tobytes().decode("ascii")
    width = digits.shape[1]
    return ["1" * z + text[r * width + s:(r + 1) * width]
            for r, (z, s) in enumerate(zip(zeros.tolist(), starts.tolist()))]


def _decode_equal(rows: np.ndarray) -> list[bytes | None]:
    """Decode a (count, length) matrix of characters; None where one is not in the alphabet."""
    count, length = rows.shape
    digits = _DIGITS[rows]
    bad = (digits < 0).any(axis=1)
    digits = np.concatenate([np.zeros((count, -length % 5), np.int64), np.maximum(digits, 0)], axis=1)
    size = int(np.ceil(length * np.log2(58) / 32)) + 1
    limbs = np.zeros((count, size), np.uint64)
    for group in range(0, digits.shape[1], 5):
        carry = np.zeros(count, np.uint64)
        for place in range(5):
            carry = carry * np.uint64(58) + digits[:, group + place].astype(np.uint64)
        for i in range(size - 1, -1, -1):
            value = limbs[:, i] * np.uint64(_GROUP) + carry
            limbs[:, i] = value & np.uint64(0xFFFFFFFF)
            carry = value >> np.uint64(32)
    raw = limbs.astype(">u4").view(np.uint8).reshape(count, size * 4)
    ones = np.where((rows != _CHARS[0]).any(axis=1), (rows != _CHARS[0]).argmax(axis=1), length)
    starts = np.where((raw != 0).any(axis=1), (raw != 0).argmax(axis=1), raw.shape[1])
    return [None if b else b"\x00" * o + raw[r, s:].tobytes()
            for r, (b, o, s) in enumerate(zip(bad.tolist(), ones.tolist(), starts.tolist()))]


def _by_length(values: list, convert, empty) -> list:
    """Apply ``convert`` to all values of one length together; None stays None."""
    out: list = [None] * len(values)
    groups: dict[int, list[int]] = {}
    for i, value in enumerate(values):
        if value is not None:
            groups.setdefault(len(value), []).append(i)
    for length, places in groups.items():
        if length == 0:
            results = [empty] * len(places)
        else:
            joined = b"".join(values[i] for i in places)
            results = convert(np.frombuffer(joined, np.uint8).reshape(len(places), length))
        for i, result in zip(places, results):
            out[i] = result
    return out


def encode_values(values: list[bytes | None]) -> list[str | None]:
    return _by_length(values, _encode_equal, "")


def decode_values(values: list[str | None]) -> list[bytes | None]:
    raw = [None if v is None else v.encode("utf-8") for v in values]
    return _by_length(raw, _decode_equal, b"")


def _each_once(values: pa.Array, convert, kind: pa.DataType) -> pa.Array:
    """``convert`` for the distinct values of a batch: the same few programs and accounts come again and again."""
    coded = values.dictionary_encode()
    return pa.array(convert(coded.dictionary.to_pylist()), kind).take(coded.indices)


@F.arrow_udf(T.StringType())
def _encode(values: pa.Array) -> pa.Array:
    return _each_once(values, encode_values, pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _encode_lists(values: pa.Array) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, _each_once(values.flatten(), encode_values, pa.string()), mask=values.is_null())


@F.arrow_udf(T.BinaryType())
def _decode(values: pa.Array) -> pa.Array:
    return _each_once(values, decode_values, pa.binary())


def base58(data: Column) -> Column:
    """Text of a BINARY column. Use it last: join and filter on BINARY."""
    return _encode(data)


def base58_list(data: Column) -> Column:
    """Text of every item of an ARRAY<BINARY> column."""
    return _encode_lists(data)


def unbase58(text: Column) -> Column:
    """Bytes of a base58 column, NULL on bad input."""
    return _decode(text)


def key_bytes(text: str) -> bytes:
    """The bytes of one base58 key, on the driver."""
    raw = decode_values([text])[0]
    if raw is None:
        raise ValueError(f"not base58: {text!r}")
    return raw


def key_literal(text: str) -> Column:
    """A base58 key as a BINARY literal, so that a filter on it is pushed to the scan."""
    return F.lit(key_bytes(text))
