"""Layouts of one shape share one decoder.

A shape is a layout without its names: every name is replaced by its number, and the names themselves travel with the
row, as a list that a lookup by (program, definition) brings. Programs have many definitions but few shapes, so plans grow
with the shapes, and a definition more is a row more in the lookup. JSON is put together from numbered names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotframe.plans.layout import Compiler, Pos, Read
from slotframe.plans.types import Interface, Layout, Opt, Prim, Rec, Seq, Sum, Unknown, has_node


@dataclass(frozen=True)
class Shape:
    """Field types without names, up to the first that is of an unknown type (its position is ``stop``)."""
    fields: tuple
    stop: int | None


@dataclass
class Catalogue:
    """``rows``: (program id, definition, shape number or None, walker number or None, names, JSON keys, stop)."""
    shapes: list[Shape] = field(default_factory=list)
    walked: list[tuple[Interface, Layout]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)


def numbered(node: object, names: list[str]) -> object:
    """The type with each name replaced by its place in ``names``, to which the names are added."""
    def fresh(given: Iterable[str]) -> list[str]:
        first = len(names)
        names.extend(given)
        return [str(first + i) for i in range(len(names) - first)]

    if isinstance(node, Opt):
        return Opt(numbered(node.item, names))
    if isinstance(node, Seq):
        return Seq(numbered(node.item, names), node.count)
    if isinstance(node, Rec):
        own = fresh(n for n, _ in node.fields)
        return Rec(tuple((n, numbered(t, names)) for n, (_, t) in zip(own, node.fields)))
    if isinstance(node, Sum):
        own = fresh(n for n, _ in node.variants)
        return Sum(tuple((n, None if fields is None else numbered(Rec(fields), names).fields)
                         for n, (_, fields) in zip(own, node.variants)))
    return node


def classify(layouts: Iterable[tuple[Interface, Layout]], fits: Callable[[Layout], bool]) -> Catalogue:
    """The distinct shapes of the layouts; those that do not fit expressions go to the row walker one by one."""
    out, known = Catalogue(), {}
    for face, layout in layouts:
        stop = next((i for i, (_, t) in enumerate(layout.fields) if has_node(t, Unknown)), None)
        if not fits(layout):
            out.rows.append((face.program_id, layout.name, None, len(out.walked), [], [], None))
            out.walked.append((face, layout))
            continue
        names = [n for n, _ in layout.fields]
        fields = tuple(numbered(t, names) for _, t in layout.fields[:stop])
        shape = Shape(fields, stop)
        if shape not in known:
            known[shape] = len(out.shapes)
            out.shapes.append(shape)
        out.rows.append((face.program_id, layout.name, known[shape], None, names[: len(layout.fields)],
                         [json.dumps(n, ensure_ascii=False) for n in names], stop))
    return out


def read_shape(shape: Shape, compiler: Compiler, start: Pos) -> tuple[list[Read], Pos]:
    reads, at = [], start
    for node in shape.fields:
        reads.append(compiler.read(node, at))
        at = reads[-1].after
    return reads, at


# ---- JSON -------------------------------------------------------------------

def _named(node: object) -> bool:
    """Whether names occur in the type, so that ``to_json`` cannot print it."""
    return has_node(node, Rec, Sum)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_text(node: object, value: Column, keys: Column, ready: Callable[[object, Column], Column]) -> Column:
    """The value as JSON text, ``null`` where it is missing. ``keys`` has the quoted names, ``ready`` prepares values of
    types without names for ``to_json``."""
    null = F.lit("null")
    if isinstance(node, Prim) and node.name in ("u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64", "bool"):
        return F.coalesce(value.cast("string"), null)
    if not _named(node):
        shown = F.to_json(F.struct(ready(node, value).alias("x")), {"ignoreNullFields": "false"})
        return _let(shown, lambda s: F.substring(s, F.lit(6), F.length(s) - 6))
    if isinstance(node, Opt):
        return json_text(node.item, value, keys, ready)
    if isinstance(node, Seq):
        items = F.transform(value, lambda v: json_text(node.item, v, keys, ready))
        return F.coalesce(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), null)
    if isinstance(node, Rec):
        return F.when(value.isNull(), null).otherwise(_object(
            [_pair(int(n), json_text(t, value[n], keys, ready), keys) for n, t in node.fields]))
    index = value["idx"]
    out = F.when(index.isNull(), null)
    for i, (name, fields) in enumerate(node.variants):
        key = F.get(keys, F.lit(int(name)))
        shown = key if fields is None else F.concat(
            F.lit("{"), key, F.lit(":"), json_text(Rec(fields), value[name], keys, ready), F.lit("}"))
        out = out.when(index == i, shown)
    return out.otherwise(F.concat(F.lit('{"variant":'), index.cast("string"), F.lit("}")))


def _pair(number: int, text: Column, keys: Column) -> Column:
    return F.concat(F.get(keys, F.lit(number)), F.lit(":"), text)


def _object(pairs: list[Column]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("{}")


def shape_json(shape: Shape, reads: list[Read], keys: Column, failed_index: Column,
               ready: Callable[[object, Column], Column]) -> Column:
    """The fields read so far, NULL for the one that failed or has no known type, nothing after it."""
    texts = [json_text(t, r.value, keys, ready) for t, r in zip(shape.fields, reads)]
    if shape.stop is not None:
        texts.append(F.lit("null"))
    return _object([F.when(failed_index.isNull() | (failed_index >= i), _pair(i, text, keys)) for i, text in enumerate(texts)])
