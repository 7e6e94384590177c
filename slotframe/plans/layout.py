"""Compiles layouts into Column expressions.

A position is either a constant or a staged column plus a constant. Everything of
fixed size is read at ``position + constant`` in one projection. Only a field of
varying size stages a new position, so the plan grows linearly with such fields.
A staged position is NULL once a read has failed or the branch is not taken, and
NULL then flows through every later expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.functions import wire
from slotframe.functions.numbers import CODES, number_list
from slotframe.plans.types import (Layout, Opt, Prim, Rec, Ref, Seq, Sum, Unknown, fixed_size,
                                   has_node, spark_type)

OK, PARTIAL, UNSUPPORTED, UNKNOWN = "ok", "partial", "unsupported", "unknown"


def compiles(node: object) -> bool:
    """Whether the node can be read by expressions; the rest goes to ``plans.walker``."""
    if isinstance(node, (Prim, Unknown)):
        return True
    if isinstance(node, Ref):
        return False
    if isinstance(node, Opt):
        return compiles(node.item)
    if isinstance(node, Seq):
        size = fixed_size(node.item)
        return compiles(node.item) and size is not None and size > 0
    if isinstance(node, Rec):
        return all(compiles(t) for _, t in node.fields)
    return all(compiles(t) for _, fields in node.variants for _, t in fields or ())


def layout_compiles(layout: Layout) -> bool:
    return all(compiles(t) or has_node(t, Unknown) for _, t in layout.fields)


def fence(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns passed through a one-row ``inline``.

    A filter on them is then evaluated above it. Without it the filter would be pushed
    below, with the expressions behind the columns spelled out and evaluated once
    more per use. Filters on other columns pass through and still reach the scan.
    """
    others = [c for c in df.columns if c not in names]
    row = F.struct(*[F.col(n) for n in names])
    return df.select(*others, F.inline(F.array(row)).alias(*names))


class Stages:
    """Intermediate columns: positions grouped by depth, each depth one select, then number words.

    Between the two stands a fence: a filter spelled out in terms of the bytes would
    double at every depth. Layouts of fixed size have no positions and no fence.
    """

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.levels: list[list[Column]] = []
        self.names: list[str] = []
        self.words: list[Column] = []

    def put(self, value: Column, depth: int) -> tuple[Column, int]:
        """Stage a position (or anything positions depend on)."""
        name = f"{self.prefix}{len(self.names)}"
        self.names.append(name)
        while len(self.levels) <= depth:
            self.levels.append([])
        self.levels[depth].append(value.alias(name))
        return F.col(name), depth + 1

    def put_word(self, value: Column) -> Column:
        """Stage a number word, which a formula uses several times."""
        name = f"{self.prefix}w{len(self.words)}"
        self.words.append(value.alias(name))
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.select("*", *level)
        if self.names:
            df = fence(df, *self.names)
        return df.select("*", *self.words) if self.words else df


@dataclass(frozen=True)
class Pos:
    """``base + shift``; ``base`` is a staged column or None for a constant position."""
    base: Column | None
    shift: int
    depth: int

    def plus(self, n: int) -> Pos:
        return Pos(self.base, self.shift + n, self.depth)

    def at(self) -> Column:
        return F.lit(self.shift) if self.base is None else self.base + self.shift


@dataclass(frozen=True)
class Read:
    """``fail`` is the offset of the first read past the end, NULL when there is none."""
    value: Column
    fail: Column
    after: Pos


def _number_list(node: object) -> bool:
    return isinstance(node, Seq) and isinstance(node.item, Prim) and node.item.name in CODES


class Compiler:
    def __init__(self, data: Column, length: Column, stages: Stages):
        self.data, self.length, self.stages = data, length, stages

    # ---- fixed size -------------------------------------------------------

    def fixed_value(self, node: object, at: Column) -> Column:
        if isinstance(node, Prim):
            return wire.read_fixed(self.data, at, node.name)
        if isinstance(node, Seq):
            return self.items(node, at, F.lit(node.count))
        if isinstance(node, Rec):
            parts, shift = [], 0
            for name, item in node.fields:
                parts.append(self.fixed_value(item, at + shift).alias(name))
                shift += fixed_size(item)
            return F.struct(*parts) if parts else F.struct()
        return self.unit_variant(node, wire.word(self.data, at, 1))

    def items(self, node: Seq, at: Column, count: Column) -> Column:
        """``count`` items of fixed size. Numbers are built from an array of words, so each word is read once."""
        size = fixed_size(node.item)
        steps = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)) \
            .otherwise(F.array().cast("array<int>"))
        if isinstance(node.item, Prim) and node.item.name in wire.NUMBERS:
            widths, build = wire.NUMBERS[node.item.name]
            if len(widths) == 1:
                read = F.transform(steps, lambda i: wire.word(self.data, at + i * size, size))
                return F.transform(read, build)
        return F.transform(steps, lambda i: self.fixed_value(node.item, at + i * size))

    def staged_value(self, node: object, pos: Pos) -> Column:
        """:meth:`fixed_value` outside of lambdas: the words of a number are staged since its formula
        uses them repeatedly, and a list of numbers is converted as a whole."""
        if isinstance(node, Prim) and node.name in wire.NUMBERS:
            staged = [self.stages.put_word(w) for w in wire.words(self.data, pos.at(), node.name)]
            return wire.NUMBERS[node.name][1](*staged)
        if _number_list(node) and node.count:
            size = fixed_size(node)
            fits = self.length >= pos.at() + size
            return number_list(F.when(fits, wire.piece(self.data, pos.at(), size)), node.item.name)
        return self.fixed_value(node, pos.at())

    def unit_variant(self, node: Sum, index: Column) -> Column:
        names = F.array(*[F.lit(name) for name, _ in node.variants])
        return F.struct(F.get(names, index.cast("int")).alias("variant"),
                        index.cast("smallint").alias("idx"))

    def fixed_fail(self, node: object, at: Column) -> Column:
        """Offset of the first primitive that does not fit, NULL when all fit."""
        if isinstance(node, (Prim, Sum)):
            return F.when(self.length < at + fixed_size(node), at)
        if isinstance(node, Rec):
            fails, shift = [], 0
            for _, item in node.fields:
                fails.append(self.fixed_fail(item, at + shift))
                shift += fixed_size(item)
            return F.coalesce(*fails) if fails else F.lit(None).cast("int")
        size = fixed_size(node.item)
        if not size or not node.count:
            return F.lit(None).cast("int")
        return F.when(self.length < at + node.count * size, self.item_fail(node.item, at, size))

    def item_fail(self, item: object, at: Column, size: int) -> Column:
        whole = F.floor((self.length - at) / size).cast("int") * size
        return self.fixed_fail(item, at + whole)

    # ---- any size ---------------------------------------------------------

    def read(self, node: object, pos: Pos) -> Read:
        size = fixed_size(node)
        if size is not None:
            fail = self.fixed_fail(node, pos.at())
            fits = fail.isNull() if pos.base is None else fail.isNull() & pos.base.isNotNull()
            return Read(F.when(fits, self.staged_value(node, pos)), fail, pos.plus(size))
        if isinstance(node, Prim):
            raw = self.counted(pos, 1, None)
            return Read(wire.utf8_text(raw.value), raw.fail, raw.after) if node.name == "string" else raw
        if isinstance(node, Opt):
            return self.option(node, pos)
        if isinstance(node, Seq):
            return self.counted(pos, fixed_size(node.item), node)
        if isinstance(node, Rec):
            return self.record(node, pos)
        return self.variant(node, pos)

    def counted(self, pos: Pos, size: int, node: Seq | None) -> Read:
        """Bytes, text and lists: a 32-bit count, then ``count * size`` bytes.

        The count is compared with the bytes that are left before anything is built from it.
        """
        start = pos.at() + 4
        has_count = self.length >= start
        count, depth = self.stages.put(
            F.when(has_count, wire.word(self.data, pos.at(), 4)), pos.depth)
        room = self.length - start
        end, depth = self.stages.put(
            F.when(count * size <= room, (start + count * size).cast("int")), depth)
        if node is None:
            item_fail = start
            value = wire.piece(self.data, start, end - start)
        else:
            item_fail = self.item_fail(node.item, start, size)
            value = number_list(wire.piece(self.data, start, end - start), node.item.name) \
                if _number_list(node) else self.items(node, start, count)
        fail = F.when(~has_count, pos.at()).when(end.isNull() & count.isNotNull(), item_fail)
        return Read(F.when(end.isNotNull(), value), fail, Pos(end, 0, depth))

    def option(self, node: Opt, pos: Pos) -> Read:
        tag, depth = self.stages.put(
            F.when(self.length > pos.at(), wire.read_bool(self.data, pos.at())), pos.depth)
        inner, inner_depth = self.stages.put(F.when(tag, pos.at() + 1), depth)
        got = self.read(node.item, Pos(inner, 0, inner_depth))
        return self.joined(F.when(~tag, pos.at() + 1), [got], pos,
                           fail=F.when(self.length <= pos.at(), pos.at()), value=got.value)

    def record(self, node: Rec, pos: Pos) -> Read:
        got, at = [], pos
        for _, item in node.fields:
            got.append(self.read(item, at))
            at = got[-1].after
        fail = F.coalesce(*[g.fail for g in got])
        reached = F.lit(True) if pos.base is None else pos.base.isNotNull()
        value = F.when(reached & fail.isNull(),
                       F.struct(*[g.value.alias(n) for (n, _), g in zip(node.fields, got)]))
        return Read(value, fail, at)

    def variant(self, node: Sum, pos: Pos) -> Read:
        index, depth = self.stages.put(
            F.when(self.length > pos.at(), wire.word(self.data, pos.at(), 1)), pos.depth)
        names = F.array(*[F.lit(name) for name, _ in node.variants])
        got, parts, taken = [], [], []
        for i, (name, fields) in enumerate(node.variants):
            if fields is None:
                continue
            inner, inner_depth = self.stages.put(F.when(index == i, pos.at() + 1), depth)
            branch = self.read(Rec(fields), Pos(inner, 0, inner_depth))
            got.append(branch)
            parts.append(branch.value.alias(name))
            taken.append(i)
        fail = F.when(self.length <= pos.at(), pos.at())
        all_fail = F.coalesce(fail, *[g.fail for g in got])
        value = F.when(index.isNotNull() & all_fail.isNull(), F.struct(
            F.get(names, index.cast("int")).alias("variant"), index.cast("smallint").alias("idx"), *parts))
        return self.joined(F.when(~index.isin(taken), pos.at() + 1), got, pos, fail=fail, value=value)

    def joined(self, plain_end: Column, got: list[Read], pos: Pos, fail: Column, value: Column) -> Read:
        """The position after whichever branch was taken."""
        depth = max([pos.depth + 1] + [g.after.depth for g in got])
        ends = [F.when(g.fail.isNull(), g.after.at()) for g in got]
        end, depth = self.stages.put(F.coalesce(plain_end, *ends), depth)
        return Read(value, F.coalesce(fail, *[g.fail for g in got]), Pos(end, 0, depth))


@dataclass(frozen=True)
class Outcome:
    """What one layout gives for a row: a value per field, and how far it got."""
    values: list[Column]
    status: Column
    failed_field: Column
    failed_offset: Column
    trailing: Column
    failed_index: Column


def compile_layout(layout: Layout, compiler: Compiler, start: Pos) -> Outcome:
    """Read the fields in order; stop at the first that is too short or of an unknown type."""
    reads: list[Read] = []
    pos, stopped = start, None
    for i, (_, node) in enumerate(layout.fields):
        if has_node(node, Unknown):
            stopped = i
            break
        reads.append(compiler.read(node, pos))
        pos = reads[-1].after
    # Staged, since the outcome columns all use them.
    index = [F.when(r.fail.isNotNull(), F.lit(i)) for i, r in enumerate(reads)]
    failed = compiler.stages.put_word(F.coalesce(*[r.fail for r in reads], F.lit(None).cast("int")))
    failed_index = compiler.stages.put_word(F.coalesce(*index, F.lit(None).cast("int")))
    values = []
    for i, (_, node) in enumerate(layout.fields):
        if i < len(reads):
            values.append(reads[i].value)
        else:
            values.append(F.lit(None).cast(spark_type(node)))
    good = F.lit(OK if stopped is None else UNSUPPORTED)
    names = F.array(*[F.lit(n) for n, _ in layout.fields]) if layout.fields else None
    if stopped is not None:
        failed_index = F.coalesce(failed_index, F.lit(stopped))
    return Outcome(
        values=values,
        status=F.when(failed.isNotNull(), F.lit(PARTIAL)).otherwise(good),
        failed_field=F.get(names, failed_index) if names is not None else F.lit(None).cast("string"),
        failed_offset=F.coalesce(failed, pos.at()) if stopped is not None else failed,
        trailing=F.when(failed.isNull(), compiler.length - pos.at()) if stopped is None
        else F.lit(None).cast("int"),
        failed_index=failed_index)

