"""Matching payloads with definitions, held against a dictionary."""

import random

import pytest

from slotframe.functions.base58 import encode_values
from slotframe.operators.dispatch import dispatch
from slotframe.plans.types import parse_interface

PROGRAMS = [bytes([n]) * 32 for n in (3, 77, 201)]


def registry(rng):
    """Programs that share discriminators and beginnings of them; some are given twice, some are of another length."""
    pool = [bytes(rng.choices(range(4), k=8)) for _ in range(12)]
    pool += [p[:7] + bytes([p[7] ^ 1]) for p in pool[:4]]
    faces = []
    for key in PROGRAMS:
        given = rng.sample(pool, 9) + rng.choices(pool, k=3) + [pool[0][:5], pool[1] + b"\x00"]
        rng.shuffle(given)
        faces.append(parse_interface({"address": encode_values([key])[0], "metadata": {"name": f"p{key[0]}"},
                                      "instructions": [{"name": f"n{i}", "discriminator": list(d)} for i, d in enumerate(given)]}))
    return pool, faces


def expected(faces):
    first = {}
    for face in faces:
        for x in face.instructions:
            if len(x.discriminator) == 8:
                first.setdefault((face.program_id, x.discriminator), x.name)
    return first


def payloads(rng, pool, faces):
    keys = {face.program_id: key for face, key in zip(faces, PROGRAMS)} | {"stranger": b"\x09" * 32}
    rows = []
    for i in range(400):
        head = rng.choice(pool)
        data = rng.choice([head, head + bytes(rng.choices(range(256), k=rng.randrange(20))), head[: rng.randrange(8)],
                           bytes(rng.choices(range(4), k=8))])
        program = rng.choice(list(keys))
        rows.append((i, program, keys[program], data))
    return rows + [(-1, faces[0].program_id, PROGRAMS[0], None), (-2, None, None, pool[0])]


def facts(spark, rows, as_bytes):
    kind = "binary" if as_bytes else "string"
    return spark.createDataFrame([(i, (key and bytearray(key)) if as_bytes else text, None if data is None else bytearray(data))
                                  for i, text, key, data in rows], f"i int, program_id {kind}, data binary")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("as_bytes", [True, False])
def test_same_as_a_dictionary(spark, seed, as_bytes):
    rng = random.Random(seed)
    pool, faces = registry(rng)
    rows, first = payloads(rng, pool, faces), expected(faces)
    got = {r.i: r for r in dispatch(facts(spark, rows, as_bytes), faces).collect()}
    assert len(got) == len(rows)
    for i, program, _, data in rows:
        name = first.get((program, data[:8])) if data is not None and len(data) >= 8 else None
        assert (got[i].name, got[i].matched) == (name or "unknown", name is not None)
        assert (got[i].data and bytes(got[i].data)) == (data and bytes(data)) if data else got[i].data in (None, bytearray())


def test_large_registries_use_the_salted_join(spark):
    rng = random.Random(5)
    pool, faces = registry(rng)
    rows = payloads(rng, pool, faces)
    table = spark.createDataFrame(
        [(face.program_id, face.name, x.ordinal, x.name, bytearray(x.discriminator)) for face in faces for x in face.instructions],
        "program_id string, program string, ordinal int, name string, discriminator binary")
    given = facts(spark, rows, False)
    few, many = dispatch(given, table), dispatch(given, table, bytes_limit=0)
    assert sorted(map(str, few.select("i", "name").collect())) == sorted(map(str, many.select("i", "name").collect()))
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in many._jdf.queryExecution().optimizedPlan().toString()


def test_large_registries_are_not_broadcast(spark):
    """Spark takes a lookup from small compressed files for a small one; a salted join that it broadcasts needs 32 times the memory."""
    rng = random.Random(6)
    pool, faces = registry(rng)
    table = spark.createDataFrame(
        [(face.program_id, face.name, x.ordinal, x.name, bytearray(x.discriminator)) for face in faces for x in face.instructions],
        "program_id string, program string, ordinal int, name string, discriminator binary")
    many = dispatch(facts(spark, payloads(rng, pool, faces), False), table, bytes_limit=0)
    many.collect()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
