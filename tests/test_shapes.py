"""Layouts of one shape share a decoder: the same outcome and JSON as the row walker, and plans that do not grow with names."""

import json
import random

import pytest
from encoder import encode, sample
from test_decode import TYPES

from slotframe.operators.decode import _fits, decode_all
from slotframe.operators.dispatch import dispatch
from slotframe.plans.shapes import classify
from slotframe.plans.types import parse_interface
from slotframe.plans.walker import read_row

KINDS = ["bool", "u8", "i16", "u32", "u64", "i64", "i128", "f32", "f64", "string", "bytes", "pubkey", {"option": "string"}, {"vec": "u16"},
         {"vec": "u64"}, {"array": ["i32", 2]}, {"option": {"vec": "pubkey"}}, {"vec": "string"}, "u256",
         *[{"defined": {"name": n}} for n in TYPES], {"option": {"defined": {"name": "V"}}}, {"vec": {"defined": {"name": "U"}}}]


def program(rng, address, count):
    """Instructions in groups of equal types under names of their own; the names inside types differ as well."""
    groups = [[rng.choice(KINDS) for _ in range(rng.randrange(5))] for _ in range(count // 3)]
    groups[0] = [{"defined": {"name": "V"}}, "u8"]
    instructions, types = [], {}
    for i in range(count):
        def own(kind, i=i):
            if isinstance(kind, dict) and "defined" in kind:
                return {"defined": {"name": rename(kind["defined"]["name"], i)}}
            return {k: own(v) if k != "array" else [own(v[0]), v[1]] for k, v in kind.items()} if isinstance(kind, dict) else kind

        def rename(name, i):
            if f"{name}{i}" not in types:
                types[f"{name}{i}"] = None
                body = TYPES[name]
                fields = lambda given: [{"name": f'{f["name"]} "é{i}', "type": own(f["type"])} for f in given]
                types[f"{name}{i}"] = {"kind": "struct", "fields": fields(body["fields"])} if body["kind"] == "struct" else {
                    "kind": "enum", "variants": [{"name": f'{v["name"]}{i}', **({"fields": fields(v["fields"])} if "fields" in v else {})}
                                                 for v in body["variants"]]}
            return f"{name}{i}"
        instructions.append({"name": f"call{i}", "args": [{"name": f"arg{i}_{k}", "type": own(t)} for k, t in enumerate(groups[i % len(groups)])]})
    document = {"address": address, "metadata": {"name": address}, "instructions": instructions,
                "types": [{"name": n, "type": t} for n, t in types.items()]}
    return document, types


def readable(described, types):
    return "u256" not in json.dumps(described) and "Tree" not in json.dumps(described)


@pytest.mark.parametrize("seed", [3, 4])
def test_same_as_the_row_walker(spark, seed):
    rng = random.Random(seed)
    rows, faces, layouts = [], [], {}
    for address in ("left", "right"):
        document, types = program(rng, address, 12)
        face = parse_interface(document)
        faces.append(face)
        for layout, given in zip(face.instructions, document["instructions"]):
            layouts[address, layout.name] = face, layout
            body = b""
            for f in given["args"]:
                body += encode(f["type"], sample(f["type"], types, rng), types) if readable(f["type"], types) else bytes(rng.choices(range(3), k=6))
            cuts = {len(body), len(body) + 2, *[rng.randrange(len(body) + 1) for _ in range(6)]}
            rows += [(len(rows) + k, address, bytes(layout.discriminator) + (body + b"\x01\x02")[:n]) for k, n in enumerate(sorted(cuts))]
    rows.append((len(rows), "left", b"nothing like it"))
    df = spark.createDataFrame([(i, p, bytearray(d)) for i, p, d in rows], "i int, program_id string, data binary")
    for limit in (1 << 20, 0):  # lookup broadcast, lookup joined
        got = {r.i: r for r in decode_all(dispatch(df, faces), faces, bytes_limit=limit).collect()}
        assert len(got) == len(rows)
        for i, program_id, data in rows:
            if got[i].name == "unknown":
                assert (got[i].args, got[i].decode_status) == (None, "unknown")
                continue
            face, layout = layouts[program_id, got[i].name]
            want = read_row(layout, data, dict(face.named), 8)
            assert (got[i].decode_status, got[i].failed_field, got[i].failed_offset, got[i].trailing_bytes) == (
                want["status"], want["failed_field"], want["failed_offset"], want["trailing"])
            assert json.loads(got[i].args) == json.loads(want["json"])
        if limit:
            assert {r.decode_status for r in got.values()} >= {"ok", "partial", "unknown"}


def face_of(count, name="call", inner="x"):
    return parse_interface({"address": "P", "metadata": {"name": "many"}, "types": [
        {"name": f"T{i}", "type": {"kind": "struct", "fields": [{"name": f"{inner}{i}", "type": "u32"}]}} for i in range(count)],
        "instructions": [{"name": f"{name}{i}", "args": [{"name": f"a{i}", "type": "string"}, {"name": f"b{i}", "type": {"defined": f"T{i}"}}]}
                         for i in range(count)]})


def test_names_do_not_make_shapes():
    face = face_of(50)
    found = classify([(face, x) for x in face.instructions], _fits)
    assert len(found.shapes) == 1 and len(found.rows) == 50
    assert found.rows[7][4:6] == (["a7", "b7"], ['"a7"', '"b7"', '"x7"'])


def test_plans_do_not_grow_with_definitions(spark):
    df = spark.createDataFrame([(bytearray(9), "P", "call1")], "data binary, program_id string, name string")

    def reads(count):
        return decode_all(df, face_of(count))._jdf.queryExecution().optimizedPlan().toString().count("conv(")
    assert reads(1) == reads(100) > 0


def test_no_definitions(spark):
    df = spark.createDataFrame([(bytearray(9), "P", "call1")], "data binary, program_id string, name string")
    assert [tuple(r)[3:5] for r in decode_all(df, []).collect()] == [(None, "unknown")]
