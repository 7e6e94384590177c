"""Registry tables, schemas and older definition shapes."""

import hashlib
import json
import zlib

import pytest
from pyspark.sql import types as T

from slotframe.functions.names import discriminator_of
from slotframe.plans.schemas import column_names, derive_schemas, empty_tables, schema_table
from slotframe.plans.types import parse_interface
from slotframe.sources.definitions import (build_registry, inflate_definitions, load_registry, load_registry_blobs,
                                           odd_discriminators, resolve_types)

SAMPLE = {
    "metadata": {"name": "orchard"},
    "types": [
        {"name": "Grade", "type": {"kind": "enum", "variants": [
            {"name": "Juice"}, {"name": "Table", "fields": [{"name": "sugar", "type": "f32"}, {"name": "stamps", "type": {"array": ["u16", 4]}}]},
            {"name": "Lost"}]}},
        {"name": "Crate", "type": {"kind": "struct", "fields": [
            {"name": "weights", "type": {"vec": "u32"}}, {"name": "grade", "type": {"option": {"defined": {"name": "Grade"}}}}]}},
        {"name": "Tree", "type": {"kind": "struct", "fields": [
            {"name": "planted", "type": "i64"}, {"name": "label", "type": "string"}, {"name": "yields", "type": {"vec": "f64"}},
            {"name": "best", "type": {"defined": {"name": "Crate"}}}, {"name": "serial", "type": "u128"}]}},
        {"name": "Season", "type": {"kind": "struct", "fields": [{"name": "days", "type": {"array": ["bool", 7]}}]}}],
    "accounts": [{"name": "Tree"}, {"name": "Season"}],
    "instructions": [
        {"name": "pickAll", "args": [{"name": "crates", "type": {"vec": {"defined": {"name": "Crate"}}}}, {"name": "by", "type": {"option": "pubkey"}}],
         "accounts": [{"name": "picker", "signer": True}, {"name": "tree", "writable": True}]},
        {"name": "prune", "args": [{"name": "cutLengths", "type": {"array": ["i16", 3]}}, {"name": "remark", "type": "string"}]},
        {"name": "restOver", "accounts": [{"name": "tree", "writable": True}, {"name": "season"}, {"name": "shed"}, {"name": "barn", "writable": True}]}]}

OLD = {
    "name": "old", "metadata": {"address": "OldAddr"},
    "instructions": [{"name": "doIt", "args": [{"name": "p", "type": {"defined": "Pair"}}],
                      "accounts": [{"name": "a", "isMut": False}, {"name": "b", "isMut": True}]}],
    "accounts": [{"name": "Box", "type": {"kind": "struct", "fields": [{"name": "n", "type": "u8"}]}}],
    "types": [{"name": "Pair", "type": {"kind": "enum", "variants": [{"name": "P", "fields": ["u8", "string"]}]}}]}


def documents(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")


def test_sample_definition(spark, tmp_path):
    for name, text in (("a", json.dumps(SAMPLE)), ("b", json.dumps(OLD)), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    registry = load_registry(spark, f"{tmp_path}/*.json")
    rows = {(r.program, r.name): r for r in registry.instructions.collect()}
    assert {n: r.writable_positions for (p, n), r in rows.items() if p == "orchard"} == {"pickAll": [1], "prune": [], "restOver": [0, 3]}
    snake = {"pickAll": "pick_all", "prune": "prune", "restOver": "rest_over"}
    assert all(bytes(rows["orchard", n].discriminator) == hashlib.sha256(f"global:{s}".encode()).digest()[:8] for n, s in snake.items())
    assert (rows["old", "doIt"].program_id, rows["old", "doIt"].writable_positions) == ("OldAddr", [1])
    accounts = {(r.program, r.name): r for r in registry.accounts.collect()}
    assert bytes(accounts["orchard", "Tree"].discriminator) == hashlib.sha256(b"account:Tree").digest()[:8]
    assert json.loads(accounts["old", "Box"].fields) == [{"name": "n", "type": "u8"}]
    assert registry.rejected.count() == 1
    assert registry.interface("OldAddr").instructions[0].fields[0][1].variants[0][1][1][0] == "1"
    with pytest.raises(KeyError):
        registry.interface("nobody")


def test_given_discriminators_count(spark):
    doc = {"metadata": {"name": "x"}, "instructions": [{"name": "a", "discriminator": [*range(40, 48)]}, {"name": "b"}],
           "accounts": [{"name": "C", "discriminator": [*range(90, 98)]}]}
    registry = build_registry(documents(spark, doc))
    assert {r.name: bytes(r.discriminator) for r in registry.instructions.collect()} == {
        "a": bytes(range(40, 48)), "b": hashlib.sha256(b"global:b").digest()[:8]}
    assert [bytes(r.discriminator) for r in registry.accounts.collect()] == [bytes(range(90, 98))]


def test_well_known_discriminator():
    # Fixed value: the published discriminator of an instruction of this name.
    assert discriminator_of("instruction", "initialize").hex() == "afaf6d1f0d989bed"


def test_derived_tables(spark):
    schemas = {t: {f.name: f.dataType.simpleString() for f in s} for t, s in derive_schemas(parse_interface(SAMPLE)).items()}
    crate = "struct<weights:array<bigint>,grade:struct<variant:string,idx:smallint,Table:struct<sugar:float,stamps:array<int>>>>"
    assert {n: schemas["orchard_ix_pickall"][n] for n in ("crates", "by")} == {"crates": f"array<{crate}>", "by": "binary"}
    assert {n: schemas["orchard_ix_prune"][n] for n in ("cutlengths", "remark")} == {"cutlengths": "array<smallint>", "remark": "string"}
    assert list(schemas["orchard_ix_restover"]) == ["transaction_signature", "outer_index", "inner_index", "instruction_index", "indexed_at"]
    assert schemas["orchard_tree"].items() >= {"planted": "bigint", "label": "string", "yields": "array<double>", "best": crate,
                                              "serial": "string", "data": "variant"}.items()
    assert schemas["orchard_season"]["days"] == "array<boolean>"
    assert all(df.count() == 0 for df in empty_tables(spark, parse_interface(SAMPLE)).values())


def test_colliding_column_names():
    doc = {"metadata": {"name": "x"}, "instructions": [], "accounts": [{"name": "A"}],
           "types": [{"name": "A", "type": {"kind": "struct", "fields": [
               {"name": "slot", "type": "u8"}, {"name": "myVal", "type": "u8"}, {"name": "myval", "type": "u8"}]}}]}
    assert list(column_names(parse_interface(doc).accounts[0]).values()) == ["slot_1", "myval", "myval_1"]


def test_type_lookup_rules(spark):
    doc = {"metadata": {"name": "x"}, "instructions": [{"name": "i", "args": [{"name": "t", "type": {"defined": {"name": "T"}}}]}],
           "accounts": [{"name": "T"}, {"name": "E"}, {"name": "None"}],
           "types": [{"name": "T", "type": {"kind": "struct", "fields": [{"name": "a", "type": "u8"}]}},
                     {"name": "T", "type": {"kind": "struct", "fields": [{"name": "b", "type": "u16"}]}},
                     {"name": "E", "type": {"kind": "enum", "variants": []}}]}
    face = parse_interface(doc)
    assert face.instructions[0].fields[0][1].fields[0][0] == "b"      # last duplicate
    assert face.accounts[0].fields[0][0] == "a"                       # first match
    assert face.accounts[1].fields == () and face.accounts[2].fields == ()
    registry = build_registry(documents(spark, doc))
    fields = {r.name: r.fields for r in registry.accounts.collect()}
    assert json.loads(fields["T"])[0]["name"] == "a" and fields["E"] is None and fields["None"] is None
    last = {r.name: r.type for r in resolve_types(registry.types).collect()}
    assert json.loads(last["T"])["fields"][0]["name"] == "b"


def test_wrong_discriminator_length_is_reported(spark):
    doc = {"metadata": {"name": "x"}, "instructions": [{"name": "i", "discriminator": [1, 2]}, {"name": "j"}]}
    assert [r.name for r in odd_discriminators(build_registry(documents(spark, doc))).collect()] == ["i"]


def test_blobs(spark):
    body = zlib.compress(json.dumps(SAMPLE).encode())
    head = bytes(8) + bytes(32)

    def blob(size, rest):
        return bytearray(head + size.to_bytes(4, "little") + rest)
    rows = [("ok", blob(len(body), body)), ("clamped", blob(10 ** 6, body)), ("cut", blob(len(body) - 3, body)),
            ("short", bytearray(44)), ("junk", blob(3, b"abc")), ("none", None)]
    blobs = spark.createDataFrame(rows, "program_id string, data binary")
    errors = {r.program_id: r.error for r in inflate_definitions(blobs).collect()}
    assert errors == {"ok": None, "clamped": None, "cut": "incomplete", "short": "too short", "junk": "not zlib", "none": "too short"}
    assert {r.program_id for r in load_registry_blobs(blobs).instructions.collect()} == {"clamped", "ok"}


def test_schema_table_matches_derived_schemas(spark):
    docs = documents(spark, SAMPLE).selectExpr("'p' as program_id", "json")
    rows = schema_table(docs).collect()
    expected = {(t, i, f.name, f.dataType.simpleString()) for t, s in derive_schemas(parse_interface(SAMPLE)).items()
                for i, f in enumerate(s)}
    assert {(r.table_name, r.ordinal, r.column_name, r.column_type) for r in rows} == expected
    assert isinstance(derive_schemas(parse_interface(SAMPLE))["transactions"]["slot"].dataType, T.LongType)
