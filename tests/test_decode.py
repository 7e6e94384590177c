"""Decoding: known byte vectors, round trips, truncation at every byte."""

import json
import math
import random
import struct
from decimal import Decimal

import pytest
from encoder import encode, sample
from pyspark.sql import functions as F

from slotframe.functions import wire
from slotframe.operators.decode import decode_all, decode_table, quarantine
from slotframe.plans.layout import layout_compiles
from slotframe.plans.types import parse_interface
from slotframe.plans.walker import read_row

DISC = bytes(range(1, 9))


def interface(args, types=(), name="go"):
    return parse_interface({
        "address": "P", "metadata": {"name": "demo"},
        "instructions": [{"name": name, "discriminator": list(DISC), "args": args}],
        "types": list(types)})


def decode(spark, args, payloads, types=(), **kw):
    face = interface(args, types)
    df = spark.createDataFrame([(i, DISC + p) for i, p in enumerate(payloads)], "i int, data binary")
    return decode_table(df, face, face.instructions[0], **kw).orderBy("i").collect()


def read_one(spark, hex_text, kind):
    df = spark.createDataFrame([(bytes.fromhex(hex_text),)], "b binary")
    return df.select(wire.read_le(F.col("b"), 0, kind)).first()[0]


@pytest.mark.parametrize("hex_text,kind,expected", [
    ("FFFFFFFFFFFFFFFF", "u64", Decimal(18446744073709551615)),
    ("C3A9C3A9C3A90000", "u64", Decimal(186657831889347)),
    ("FFFFFFFFFFFFFFFF", "i64", -1),
    ("80", "i8", -128), ("0080", "i16", -32768), ("00000080", "i32", -2147483648),
    ("FF" * 16, "u128", "340282366920938463463374607431768211455"),
    ("00" * 16, "u128", "0"), ("01" + "00" * 15, "u128", "1"),
    ("00" * 8 + "01" + "00" * 7, "u128", str(2 ** 64)),
    ("00" * 15 + "80", "i128", "-170141183460469231731687303715884105728"),
    ("FF" * 16, "i128", "-1"), ("02", "bool", True), ("00", "bool", False),
    ("010203", "u32", None),
])
def test_primitive_vectors(spark, hex_text, kind, expected):
    assert read_one(spark, hex_text, kind) == expected


def test_floats_keep_their_bits(spark):
    values = [3.14, -0.0, 5e-324, float("nan"), float("inf"), -float("inf"), 1.7976931348623157e308, 2.2250738585072014e-308]
    df = spark.createDataFrame([(i, struct.pack("<d", v), struct.pack("<f", v if abs(v) < 3e38 or v != v or math.isinf(v) else 3.4028234663852886e38))
                                for i, v in enumerate(values)], "i int, d binary, f binary")
    rows = df.orderBy("i").select(wire.read_le(F.col("d"), 0, "f64"), wire.read_le(F.col("f"), 0, "f32"), "f").collect()
    for v, (d, f, raw) in zip(values, rows):
        assert math.isnan(d) if v != v else struct.pack("<d", d) == struct.pack("<d", v)
        assert math.isnan(f) if v != v else struct.pack("<f", f) == bytes(raw)


def test_sequence_of_primitives(spark):
    args = [{"name": n, "type": t} for n, t in zip("pqrst", ["u32", "string", "i16", "bool", "u8"])]
    raw = struct.pack("<I", 3_000_000_001) + struct.pack("<I", 7) + "größer".encode()[:7] + struct.pack("<h?B", -31_000, False, 250)
    row = decode(spark, args, [raw])[0]
    assert (row.p, row.q, row.r, row.s, row.t) == (3_000_000_001, "größe", -31_000, False, 250)
    assert (row.decode_status, row.trailing_bytes) == ("ok", 0)


def test_short_payloads_keep_what_was_read(spark):
    args = [{"name": "a", "type": "i32"}, {"name": "b", "type": "u64"}, {"name": "c", "type": "u8"}]
    row = decode(spark, args, [struct.pack("<i", -77) + b"\x05\x06\x07"], json_column="j")[0]
    assert (row.a, row.b, row.c) == (-77, None, None)
    assert (row.decode_status, row.failed_field, row.failed_offset, row.trailing_bytes) == ("partial", "b", 12, None)
    assert json.loads(row.j) == {"a": -77, "b": None}


def test_invalid_text_is_replaced(spark):
    row = decode(spark, [{"name": "s", "type": "string"}], [bytes.fromhex("0300000061FF62")])[0]
    assert row.s == "a�b"


def test_option_tags(spark):
    rows = decode(spark, [{"name": "o", "type": {"option": "u8"}}], [b"\x00", b"\x01\x2a", b"\x07\x2a", b"\x01", b""])
    assert [r.o for r in rows] == [None, 42, 42, None, None]
    assert [(r.decode_status, r.failed_offset) for r in rows] == [
        ("ok", None), ("ok", None), ("ok", None), ("partial", 9), ("partial", 8)]


def test_huge_counts_build_nothing(spark):
    rows = decode(spark, [{"name": "v", "type": {"vec": "u8"}}, {"name": "w", "type": "u8"}],
                  [b"\xff\xff\xff\xff", b"\x02\x00\x00\x00\x01\x02\x03\x09"])
    assert (rows[0].v, rows[0].decode_status, rows[0].failed_offset) == (None, "partial", 12)
    assert (rows[1].v, rows[1].w, rows[1].trailing_bytes) == ([1, 2], 3, 1)


ENUM = {"name": "E", "type": {"kind": "enum", "variants": [
    {"name": "A"}, {"name": "B", "fields": [{"name": "x", "type": "u16"}, {"name": "s", "type": "string"}]}]}}


def test_enum_shapes(spark):
    args = [{"name": "e", "type": {"defined": {"name": "E"}}}, {"name": "z", "type": "u8"}]
    rows = decode(spark, args, [b"\x00\x05", b"\x01\x02\x00\x01\x00\x00\x00q\x06", b"\x63\x07", b"\x01\x02"],
                  [ENUM], json_column="j")
    assert [json.loads(r.j) for r in rows] == [
        {"e": "A", "z": 5}, {"e": {"B": {"x": 2, "s": "q"}}, "z": 6}, {"e": {"variant": 99}, "z": 7}, {"e": None}]
    assert rows[3].failed_offset == 9


def test_unknown_types_stop_the_record(spark):
    args = [{"name": "a", "type": "u8"}, {"name": "b", "type": "u256"}, {"name": "c", "type": "u8"}]
    row = decode(spark, args, [b"\x01\x02\x03"])[0]
    assert (row.a, row.b, row.c, row.decode_status, row.failed_field) == (1, None, None, "unsupported", "b")


TYPES = {
    "P": {"kind": "struct", "fields": [{"name": "k", "type": "pubkey"}, {"name": "n", "type": "i16"}]},
    "Q": {"kind": "struct", "fields": [{"name": "s", "type": "string"}, {"name": "o", "type": {"option": "u64"}}]},
    "U": {"kind": "enum", "variants": [{"name": "One"}, {"name": "Two"}]},
    "V": {"kind": "enum", "variants": [
        {"name": "Nil"}, {"name": "Num", "fields": [{"name": "v", "type": "u128"}]},
        {"name": "Txt", "fields": [{"name": "s", "type": "string"}, {"name": "l", "type": {"vec": "i32"}}]}]},
    "Tree": {"kind": "struct", "fields": [{"name": "v", "type": "u8"},
                                          {"name": "kids", "type": {"vec": {"defined": {"name": "Tree"}}}}]},
}
LAYOUTS = {
    "all_fixed": ["bool", "u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "u128", "i128", "f32", "f64",
                  "pubkey", {"array": ["u16", 3]}, {"defined": {"name": "P"}}, {"defined": {"name": "U"}},
                  {"array": [{"defined": {"name": "P"}}, 2]}],
    "varying": ["string", "u8", "bytes", {"option": "string"}, {"option": "pubkey"}, {"vec": "u16"},
                {"vec": "pubkey"}, {"vec": {"defined": {"name": "P"}}}, {"defined": {"name": "Q"}},
                {"defined": {"name": "V"}}, {"option": {"defined": {"name": "V"}}}, "i64"],
    "nested_lists": ["u8", {"vec": "string"}, {"vec": {"vec": "u8"}}, {"array": ["string", 2]}, "u16"],
    "tree": ["u8", {"defined": {"name": "Tree"}}, "u8"],
}


def same(a, b):
    if isinstance(a, float):
        return (math.isnan(a) and math.isnan(b)) or a == b
    if isinstance(b, (bytes, bytearray)):
        return bytes(a) == bytes(b)
    if isinstance(b, Decimal):
        return Decimal(a) == b
    if isinstance(a, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if isinstance(a, dict):
        return b is not None and all(same(v, b[k]) for k, v in a.items())
    return a == b


@pytest.mark.parametrize("which", list(LAYOUTS))
def test_round_trip(spark, which):
    rng = random.Random(7)
    args = [{"name": f"f{i}", "type": t} for i, t in enumerate(LAYOUTS[which])]
    types = [{"name": n, "type": t} for n, t in TYPES.items()]
    face = interface(args, types)
    assert layout_compiles(face.instructions[0]) == (which in ("all_fixed", "varying"))
    values = [[sample(a["type"], TYPES, rng) for a in args] for _ in range(60)] \
        if which != "tree" else [[1, {"v": 2, "kids": [{"v": 3, "kids": []}]}, 4]]
    payloads = [b"".join(encode(a["type"], v, TYPES) for a, v in zip(args, row)) for row in values]
    rows = decode(spark, args, [p + b"\x00\x00" for p in payloads], types, json_column="j")
    for expected, got, payload in zip(values, rows, payloads):
        assert (got.decode_status, got.trailing_bytes) == ("ok", 2)
        if which == "tree":
            assert json.loads(got.f1.toJson()) == expected[1]
        else:
            for i, e in enumerate(expected):
                assert same(e, got[f"f{i}"]), (i, e, got[f"f{i}"])
        walked = read_row(face.instructions[0], DISC + payload, dict(face.named), 8)
        assert json.loads(got.j) == json.loads(walked["json"])


@pytest.mark.parametrize("which", ["all_fixed", "varying", "nested_lists"])
def test_every_prefix_decodes_partially(spark, which):
    """Both readers agree on status, field and offset at every cut, and none throws."""
    rng = random.Random(11)
    args = [{"name": f"f{i}", "type": t} for i, t in enumerate(LAYOUTS[which])]
    types = [{"name": n, "type": t} for n, t in TYPES.items()]
    face = interface(args, types)
    payload = b"".join(encode(a["type"], sample(a["type"], TYPES, rng), TYPES) for a in args)
    cuts = [payload[:n] for n in range(len(payload) + 1)]
    rows = decode(spark, args, cuts, types, json_column="j")
    for cut, got in zip(cuts, rows):
        walked = read_row(face.instructions[0], DISC + cut, dict(face.named), 8)
        assert (got.decode_status, got.failed_field, got.failed_offset, got.trailing_bytes) == (
            walked["status"], walked["failed_field"], walked["failed_offset"], walked["trailing"])
        assert json.loads(got.j) == json.loads(walked["json"])
        assert (got.decode_status == "ok") == (len(cut) == len(payload))


def test_one_pass_over_several_definitions(spark):
    face = parse_interface({"address": "P", "metadata": {"name": "demo"}, "instructions": [
        {"name": "a", "discriminator": [1] * 8, "args": [{"name": "n", "type": "u8"}]},
        {"name": "b", "discriminator": [2] * 8, "args": [{"name": "s", "type": "string"}, {"name": "k", "type": "pubkey"}]},
        {"name": "c", "discriminator": [3] * 8},
        {"name": "d", "discriminator": [4] * 8, "args": [{"name": "l", "type": {"vec": "string"}}]}]})
    rows = [("a", b"\x01" * 8 + b"\x09"), ("b", b"\x02" * 8 + b"\x01\x00\x00\x00x" + bytes(32)), ("c", b"\x03" * 8),
            ("d", b"\x04" * 8 + b"\x01\x00\x00\x00\x01\x00\x00\x00y"), ("a", b"\x01" * 8), ("unknown", b"\x05")]
    df = spark.createDataFrame([(i, "P", *r) for i, r in enumerate(rows)], "i int, program_id string, name string, data binary")
    out = decode_all(df, face).orderBy("i").collect()
    assert [r.args and json.loads(r.args) for r in out] == [
        {"n": 9}, {"s": "x", "k": "1" * 32}, {}, {"l": ["y"]}, {"n": None}, None]
    assert [r.decode_status for r in out] == ["ok"] * 4 + ["partial", "unknown"]
    assert quarantine(decode_all(df, face)).count() == 2


def test_plan_grows_linearly(spark):
    def conversions(n):
        face = interface([{"name": f"f{i}", "type": "string"} for i in range(n)])
        df = spark.createDataFrame([(DISC,)], "data binary")
        plan = decode_table(df, face, face.instructions[0])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("conv(")
    two, four, eight = (conversions(n) for n in (2, 4, 8))
    assert (four, eight) == (2 * two, 4 * two)
