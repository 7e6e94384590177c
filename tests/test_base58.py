"""base58 against a plain big-number version."""

import random

import pytest
from pyspark.sql import functions as F

from slotframe.functions.base58 import (ALPHABET, base58, base58_list, decode_values, encode_values, key_literal,
                                        unbase58)


def plain(raw):
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = ALPHABET[d] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def test_values():
    rng = random.Random(3)
    raws = [bytes(32), b"", b"\0", b"\0\0\x01", b"\xff" * 64, b"hello", None]
    raws += [bytes(rng.choice([0, 255, rng.getrandbits(8)]) for _ in range(rng.randrange(70))) for _ in range(800)]
    texts = encode_values(raws)
    assert texts == [None if r is None else plain(r) for r in raws]
    assert texts[0] == "1" * 32
    assert decode_values(texts) == raws
    assert decode_values(["0", "l", "1é", None, "abc!"]) == [None] * 5


def test_columns(spark):
    df = spark.createDataFrame([(bytearray(b"\0ab"), [bytearray(b"x"), None]), (None, None)], "b binary, l array<binary>")
    rows = df.select(base58(F.col("b")), base58_list(F.col("l")), unbase58(base58(F.col("b")))).collect()
    assert tuple(rows[0]) == (plain(b"\0ab"), [plain(b"x"), None], bytearray(b"\0ab"))
    assert tuple(rows[1]) == (None, None, None)
    assert df.where(F.col("b") == key_literal(plain(b"\0ab"))).count() == 1
    with pytest.raises(ValueError):
        key_literal("0OIl")


def test_functions_travel_without_the_package(tmp_path):
    """Executors may not have the package; its functions must load from their pickle alone."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from slotframe.sources.messages import parse_message
    code = "import pickle, sys; f, g = pickle.loads(sys.stdin.buffer.read()); print(f([b'a']), g(b''))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps((encode_values, parse_message)),
                          cwd=tmp_path, capture_output=True, timeout=60)
    assert done.stdout.decode().strip() == "['2g'] None", done.stderr.decode()


def test_equal_values_of_a_batch_are_converted_once(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from slotframe.functions import base58 as b58

    seen = []
    got = b58._each_once(pa.array([b"\x01", None, b"\x02", b"\x01", b""]), lambda v: seen.extend(v) or b58.encode_values(v), pa.string())
    assert got.to_pylist() == ["2", None, "3", "2", ""] and sorted(seen) == [b"", b"\x01", b"\x02"]
    rows = [[b"\x01", None, b"\x01"], None, [], [b"", b"\x02" * 32], [None]]
    lists = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, keys array<binary>").coalesce(1)
    shown = {r.i: r.t for r in lists.select("i", b58.base58_list(F.col("keys")).alias("t")).collect()}
    assert shown == {i: None if r is None else b58.encode_values(r) for i, r in enumerate(rows)}
