"""The type tree of an interface definition, and its Spark types."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from slotframe.functions.names import discriminator_of
from slotframe.functions.wire import FIXED_SIZES


@dataclass(frozen=True)
class Prim:
    name: str


@dataclass(frozen=True)
class Opt:
    item: object


@dataclass(frozen=True)
class Seq:
    """``count`` is None for a counted list, else a fixed length."""
    item: object
    count: int | None = None


@dataclass(frozen=True)
class Rec:
    fields: tuple


@dataclass(frozen=True)
class Sum:
    """``variants`` holds (name, fields or None)."""
    variants: tuple


@dataclass(frozen=True)
class Unknown:
    name: str


@dataclass(frozen=True)
class Ref:
    """A type that contains itself; looked up in the definition while reading."""
    name: str


@dataclass(frozen=True)
class Layout:
    """One instruction or account type."""
    kind: str
    program_id: str
    program: str
    name: str
    ordinal: int
    discriminator: bytes
    fields: tuple
    writable: tuple = ()


@dataclass(frozen=True)
class Interface:
    program_id: str
    name: str
    instructions: tuple
    accounts: tuple
    named: tuple  # (type name, node): what Ref points at

    def layouts(self, kind: str) -> tuple:
        return self.instructions if kind == "instruction" else self.accounts

    def find(self, kind: str, name: str) -> Layout:
        """The definition of that exact name; KeyError when there is none."""
        for layout in self.layouts(kind):
            if layout.name == name:
                return layout
        raise KeyError(f"unknown {kind} type {name!r}")


PRIMITIVES = {
    "bool": T.BooleanType(), "u8": T.ShortType(), "i8": T.ByteType(), "u16": T.IntegerType(),
    "i16": T.ShortType(), "u32": T.LongType(), "i32": T.IntegerType(), "u64": T.DecimalType(20, 0),
    "i64": T.LongType(), "u128": T.StringType(), "i128": T.StringType(), "f32": T.FloatType(),
    "f64": T.DoubleType(), "string": T.StringType(), "pubkey": T.BinaryType(),
    "publicKey": T.BinaryType(), "bytes": T.BinaryType(),
}


def _named_fields(fields: list) -> list[tuple[str, object]]:
    """(name, type) pairs; tuple-like fields are named by position."""
    return [(f["name"], f["type"]) if isinstance(f, dict) and "name" in f else (str(i), f)
            for i, f in enumerate(fields)]


class _Resolver:
    """Turns type descriptions into nodes; keeps the types that refer to themselves."""

    def __init__(self, types: dict):
        self.types = types
        self.recursive: set[str] = set()

    def node(self, described: object, open_names: tuple = ()) -> object:
        if isinstance(described, str):
            return Prim(described) if described in PRIMITIVES else Unknown(described)
        if "option" in described:
            return Opt(self.node(described["option"], open_names))
        if "vec" in described:
            return Seq(self.node(described["vec"], open_names))
        if "array" in described:
            item, count = described["array"]
            return Seq(self.node(item, open_names), int(count))
        if "defined" in described:
            target = described["defined"]
            return self.defined(target if isinstance(target, str) else target["name"], open_names)
        return Unknown(json.dumps(described))

    def defined(self, name: str, open_names: tuple = ()) -> object:
        if name not in self.types:
            return Unknown(name)
        if name in open_names:
            self.recursive.add(name)
            return Ref(name)
        body, inside = self.types[name], open_names + (name,)
        if body["kind"] == "struct":
            return Rec(self.fields(body.get("fields") or [], inside))
        return Sum(tuple(
            (v["name"], None if v.get("fields") is None else self.fields(v["fields"], inside))
            for v in body.get("variants") or []))

    def fields(self, fields: list, open_names: tuple = ()) -> tuple:
        return tuple((name, self.node(t, open_names)) for name, t in _named_fields(fields))


def describe(described: object) -> object:
    """The node of a type that has no definition behind it."""
    return _Resolver({}).node(described)


def parse_interface(document: str | dict, program_id: str | None = None) -> Interface:
    """One JSON definition. Older shapes (name on top, types as text, isMut) are read too."""
    doc = json.loads(document) if isinstance(document, str) else document
    meta = doc.get("metadata") or {}
    name = meta.get("name") or doc["name"]
    key = program_id or doc.get("address") or meta.get("address") or name
    described = doc.get("types") or []
    types = {t["name"]: t["type"] for t in described}  # the last duplicate wins
    resolver = _Resolver(types)

    def layout(kind: str, ordinal: int, item: dict, fields: tuple, writable: tuple = ()) -> Layout:
        disc = bytes(item.get("discriminator") or b"") or discriminator_of(kind, item["name"])
        return Layout(kind, key, name, item["name"], ordinal, disc, fields, writable)

    instructions = tuple(
        layout("instruction", i, ix, resolver.fields(ix.get("args") or []),
               tuple(p for p, meta_ in enumerate(ix.get("accounts") or [])
                     if meta_.get("writable") or meta_.get("isMut")))
        for i, ix in enumerate(doc.get("instructions") or []))

    def account_fields(item: dict) -> tuple:
        # The first type of that name counts, and only if it is a struct. Old
        # definitions carry the type inside the account itself.
        first = next((t["type"] for t in described if t["name"] == item["name"]), item.get("type"))
        if first is None or first["kind"] != "struct":
            return ()
        return resolver.fields(first.get("fields") or [], (item["name"],))

    accounts = tuple(layout("account", i, a, account_fields(a))
                     for i, a in enumerate(doc.get("accounts") or []))
    named = tuple((n, resolver.defined(n)) for n in sorted(resolver.recursive))
    return Interface(key, name, instructions, accounts, named)


def walk_nodes(node: object):
    """The node and everything below it."""
    yield node
    below = ()
    if isinstance(node, (Opt, Seq)):
        below = (node.item,)
    elif isinstance(node, Rec):
        below = tuple(t for _, t in node.fields)
    elif isinstance(node, Sum):
        below = tuple(t for _, fields in node.variants for _, t in fields or ())
    for item in below:
        yield from walk_nodes(item)


def has_node(node: object, *kinds: type) -> bool:
    return any(isinstance(n, kinds) for n in walk_nodes(node))


def spark_type(node: object) -> T.DataType:
    """Column type of a field. Unsigned types are widened so that no value overflows."""
    if has_node(node, Ref, Unknown):
        return T.VariantType()
    if isinstance(node, Prim):
        return PRIMITIVES[node.name]
    if isinstance(node, Opt):
        return spark_type(node.item)
    if isinstance(node, Seq):
        return T.ArrayType(spark_type(node.item))
    if isinstance(node, Rec):
        return T.StructType([T.StructField(n, spark_type(t)) for n, t in node.fields])
    payloads = [T.StructField(n, spark_type(Rec(fields))) for n, fields in node.variants
                if fields is not None]
    return T.StructType([T.StructField("variant", T.StringType()),
                         T.StructField("idx", T.ShortType()), *payloads])


def fixed_size(node: object) -> int | None:
    """Byte width when it does not depend on the data, else None."""
    if isinstance(node, Prim):
        return FIXED_SIZES.get(node.name)
    if isinstance(node, Seq) and node.count is not None:
        item = fixed_size(node.item)
        return None if item is None else item * node.count
    if isinstance(node, Rec):
        sizes = [fixed_size(t) for _, t in node.fields]
        return None if None in sizes else sum(sizes)
    if isinstance(node, Sum) and all(fields is None for _, fields in node.variants):
        return 1
    return None
