"""Raw transactions to flat rows; wire messages."""

import base64
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from slotframe.functions.base58 import encode_values
from slotframe.operators.flatten import (flatten_instructions, ledger_instructions, ledger_transactions,
                                         nested_ledger, overflowed, to_transactions, touched_accounts)
from slotframe.sources.messages import parse_message, unpack_messages

K = [bytes([i]) * 32 for i in range(4)]
IX = "struct<program_index:int, account_indices:array<int>, data:binary>"


def raw(spark, inner_data="binary", **over):
    schema = (f"signature string, slot bigint, block_time bigint, err string, fee decimal(20,0), "
              f"message struct<account_keys:array<binary>, instructions:array<{IX}>>, "
              f"inner array<struct<outer_index:int, instructions:array<{IX.replace('binary', inner_data)}>>>, "
              f"loaded_keys array<binary>")
    text = inner_data == "string"
    d = (lambda b: encode_values([b])[0]) if text else bytearray
    row = {"signature": "s", "slot": 7, "block_time": 0, "err": None, "fee": Decimal(5),
           "message": (list(map(bytearray, K[:3])), [(0, [1, 9, 3], bytearray(b"a")), (8, [], bytearray(b"b"))]),
           "inner": [(0, [(1, [0], d(b"c")), (2, [1], d(b"d"))]), (0, [(1, [0], d(b"x"))]), (5, [(1, [0], d(b"y"))])],
           "loaded_keys": None, **over}
    return spark.createDataFrame([tuple(row.values())], schema)


def test_nested_calls_keep_their_own_keys(spark):
    rows = flatten_instructions(raw(spark)).collect()
    assert [(r.outer_index, r.inner_index, r.instruction_index, bytes(r.data)) for r in rows] == [
        (0, None, 0, b"a"), (0, 0, 0, b"c"), (0, 1, 1, b"d"), (1, None, 1, b"b")]
    assert len({(r.outer_index, r.inner_index) for r in rows}) == 4


def test_indices_out_of_range(spark):
    first, *_, last = flatten_instructions(raw(spark)).collect()
    assert [a and bytes(a) for a in first.accounts] == [K[1], None, None]
    assert last.program_id is None
    compact = flatten_instructions(raw(spark), compact=True).first()
    assert [bytes(a) for a in compact.accounts] == [K[1]]
    loaded = flatten_instructions(raw(spark, loaded_keys=[bytearray(K[3])])).first()
    assert [a and bytes(a) for a in loaded.accounts] == [K[1], None, K[3]]


def test_inner_data_as_text(spark):
    rows = flatten_instructions(raw(spark, inner_data="string")).collect()
    assert [bytes(r.data) for r in rows] == [b"a", b"c", b"d", b"b"]
    bad = [(0, [(1, [0], "0bad0")])]
    assert [bytes(r.data) for r in flatten_instructions(raw(spark, "string", inner=bad)).collect()] == [b"a", b"", b"b"]


def test_no_metadata_means_success(spark):
    df = raw(spark, fee=None, block_time=None)
    row = to_transactions(df).first()
    assert (row.success, row.fee, row.block_time, row.err_msg) == (True, None, None, None)
    assert to_transactions(raw(spark, err="boom")).first().success is False


def test_values_beyond_signed_64_bits_are_set_aside(spark):
    df = raw(spark, fee=Decimal(2 ** 63))
    assert to_transactions(df).first().fee is None
    assert overflowed(df).count() == 1 and overflowed(raw(spark)).count() == 0


def test_nested_table_gives_both_flat_tables(spark):
    nested = nested_ledger(raw(spark), F.lit("2024-01-01").cast("timestamp"))
    assert ledger_instructions(nested).count() == 4
    assert ledger_transactions(nested).drop("indexed_at").collect() == to_transactions(raw(spark)).drop("indexed_at").collect()


def test_touched_accounts(spark):
    df = spark.createDataFrame([
        Row(transaction_signature="s", slot=1, outer_index=0, inner_index=0, program_id="p", matched=True,
            accounts=[bytearray(b"a"), None], writable_positions=[0, 1, 5]),
        Row(transaction_signature="t", slot=1, outer_index=0, inner_index=0, program_id="p", matched=False,
            accounts=[bytearray(b"a")], writable_positions=None)],
        "transaction_signature string, slot bigint, outer_index int, inner_index int, program_id string, matched boolean, "
        "accounts array<binary>, writable_positions array<int>")
    assert [(r.transaction_signature, bytes(r.pubkey)) for r in touched_accounts(df).collect()] == [("s", b"a")]


def wire(version=b"", tail=b"", keys=2):
    body = b"\x01" + bytes(64) + version + b"\x01\x00\x01" + bytes([keys]) + b"".join(K[:keys]) + bytes(32)
    return body + b"\x01" + b"\x01" + b"\x02\x00\x01" + b"\x03abc" + tail


def test_messages():
    expected = {"account_keys": K[:2], "instructions": [{"program_index": 1, "account_indices": [0, 1], "data": b"abc"}]}
    assert parse_message(wire()) == expected
    assert parse_message(wire() + b"more") == expected
    assert parse_message(wire(b"\x80", b"\x01" + bytes(32) + b"\x01\x00" + b"\x00")) == expected
    assert parse_message(wire(b"\x81")) is None
    assert parse_message(wire(b"\x80")) is None
    assert all(parse_message(wire()[:n]) is None for n in range(len(wire())))
    assert parse_message(b"\x80\x00" + wire()[1:]) is None  # padded length


@pytest.mark.parametrize("text,status", [("***", "bad_base64"), (base64.b64encode(b"\x01").decode(), "bad_message"),
                                         (None, "missing"), (base64.b64encode(wire()).decode(), "ok")])
def test_unreadable_records_keep_their_row(spark, text, status):
    df = spark.createDataFrame([("s", 1, text)], "signature string, slot bigint, wire_base64 string")
    rows = unpack_messages(df)
    assert [r.unpack_status for r in rows.collect()] == [status]
    assert flatten_instructions(rows).count() == (1 if status == "ok" else 0)


def test_accounts_with_and_without_missing_ones_need_no_shuffle(spark):
    """The two lists come from one row; a join of all instructions with themselves moved every key twice."""
    from slotframe import catalog

    rows = catalog.QUERIES["resolve_accounts"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert all(r.compact == r.accounts.replace(",-", "") for r in rows.limit(50).collect())
