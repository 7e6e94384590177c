"""Writes values in the binary layout with ``struct``; shares nothing with the readers."""

import random
import struct

CODES = {"u8": "B", "i8": "b", "u16": "H", "i16": "h", "u32": "I", "i32": "i", "u64": "Q", "i64": "q",
         "f32": "f", "f64": "d"}


def encode(described, value, types):
    if isinstance(described, str):
        if described == "bool":
            return b"\x01" if value else b"\x00"
        if described in CODES:
            return struct.pack("<" + CODES[described], value)
        if described in ("u128", "i128"):
            return int(value).to_bytes(16, "little", signed=described == "i128")
        if described == "pubkey":
            return value
        body = value.encode() if described == "string" else value
        return struct.pack("<I", len(body)) + body
    if "option" in described:
        return b"\x00" if value is None else b"\x01" + encode(described["option"], value, types)
    if "vec" in described:
        return struct.pack("<I", len(value)) + b"".join(encode(described["vec"], v, types) for v in value)
    if "array" in described:
        return b"".join(encode(described["array"][0], v, types) for v in value)
    body = types[described["defined"]["name"]]
    if body["kind"] == "struct":
        return b"".join(encode(f["type"], value[f["name"]], types) for f in body["fields"])
    variant = body["variants"][value["idx"]]
    out = bytes([value["idx"]])
    for f in variant.get("fields") or []:
        out += encode(f["type"], value[variant["name"]][f["name"]], types)
    return out


def sample(described, types, rng: random.Random):
    if isinstance(described, str):
        if described == "bool":
            return rng.random() < 0.5
        if described in ("f32", "f64"):
            v = rng.choice([0.0, -0.0, 1.5, -3.25, float("inf"), 5e-324, 1e300, rng.uniform(-1e6, 1e6)])
            return struct.unpack("<f", struct.pack("<f", 5e-45 if abs(v) > 1e38 or 0 < abs(v) < 1e-300 else v))[0] \
                if described == "f32" else v
        if described in ("u128", "i128"):
            bits = rng.choice([1, 64, 65, 100, 127, 128])
            v = rng.getrandbits(bits)
            return str(v if described == "u128" else v - 2 ** 127)
        if described in CODES:
            bits = int(described[1:])
            v = rng.choice([0, 2 ** bits - 1, 2 ** (bits - 1), rng.getrandbits(bits)])
            return v if described[0] == "u" else v - 2 ** (bits - 1)
        if described == "pubkey":
            return bytes(rng.choice([0, rng.getrandbits(8)]) for _ in range(32))
        if described == "bytes":
            return bytes(rng.getrandbits(8) for _ in range(rng.randrange(6)))
        return "".join(rng.choice("abcé漢😀 \"\\\n") for _ in range(rng.randrange(6)))
    if "option" in described:
        return None if rng.random() < 0.4 else sample(described["option"], types, rng)
    if "vec" in described:
        return [sample(described["vec"], types, rng) for _ in range(rng.randrange(4))]
    if "array" in described:
        return [sample(described["array"][0], types, rng) for _ in range(described["array"][1])]
    body = types[described["defined"]["name"]]
    if body["kind"] == "struct":
        return {f["name"]: sample(f["type"], types, rng) for f in body["fields"]}
    idx = rng.randrange(len(body["variants"]))
    variant = body["variants"][idx]
    out = {"variant": variant["name"], "idx": idx}
    for v in body["variants"]:
        if v.get("fields") is not None:
            out[v["name"]] = None
    if variant.get("fields") is not None:
        out[variant["name"]] = {f["name"]: sample(f["type"], types, rng) for f in variant["fields"]}
    return out
