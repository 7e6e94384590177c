"""Bulk decoding of dispatched payloads into typed columns."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.base58 import base58, base58_list, key_bytes, key_literal
from slotframe.functions.names import DISCRIMINATOR_BYTES, sanitize_name
from slotframe.operators import manifest
from slotframe.operators.dispatch import BROADCAST_BYTES, attach_small, dispatch
from slotframe.operators.flatten import flatten_instructions
from slotframe.plans.layout import (OK, PARTIAL, UNKNOWN, UNSUPPORTED, Compiler, Outcome, Pos, Stages, compile_layout,
                                    layout_compiles)
from slotframe.plans.schemas import column_names, table_name, typed_schema
from slotframe.plans.shapes import Catalogue, classify, read_shape, shape_json
from slotframe.plans.types import (Interface, Layout, Opt, Prim, Rec, Ref, Seq, Unknown, has_node,
                                   spark_type, walk_nodes)
from slotframe.plans.walker import walk_any, walk_column

OUTCOME = ("decode_status", "failed_field", "failed_offset", "trailing_bytes")
BINARY_PRIMS = ("pubkey", "publicKey", "bytes")


# ---- JSON form --------------------------------------------------------------

def _is_plain(node: object) -> bool:
    """Whether ``to_json`` already prints the value as wanted."""
    return all(isinstance(n, (Opt, Seq, Rec)) or
               (isinstance(n, Prim) and n.name not in (*BINARY_PRIMS, "f32", "f64"))
               for n in walk_nodes(node))


def renders(node: object, in_list: bool = False) -> bool:
    """Whether :func:`json_ready` can be expressed without the row walker."""
    if isinstance(node, (Ref, Unknown)):
        return False
    if isinstance(node, Prim):
        return not (in_list and node.name in BINARY_PRIMS)
    if isinstance(node, Opt):
        return renders(node.item, in_list)
    if isinstance(node, Seq):
        if isinstance(node.item, Prim) and node.item.name in BINARY_PRIMS:
            return not in_list
        return renders(node.item, True)
    groups = [node.fields] if isinstance(node, Rec) else [f or () for _, f in node.variants]
    return all(renders(t, in_list) for fields in groups for _, t in fields)


def json_ready(node: object, value: Column) -> Column:
    """The value in a form that ``to_json`` prints as the JSON shape of its type."""
    if _is_plain(node):
        return value
    if isinstance(node, Prim):
        if node.name in BINARY_PRIMS:
            return base58(value)
        wide = value.cast("double")  # as every other reader of the bytes shows an f32
        finite = ~(F.isnan(wide) | (F.abs(wide) == float("inf")))
        return F.when(finite, wide)
    if isinstance(node, Opt):
        return json_ready(node.item, value)
    if isinstance(node, Seq):
        if isinstance(node.item, Prim) and node.item.name in BINARY_PRIMS:
            return base58_list(value)
        return F.transform(value, lambda v: json_ready(node.item, v))
    if isinstance(node, Rec):
        return F.when(value.isNotNull(),
                      F.struct(*[json_ready(t, value[n]).alias(n) for n, t in node.fields]))
    text = F.when(value["variant"].isNull() & value["idx"].isNotNull(),
                  F.concat(F.lit('{"variant":'), value["idx"].cast("string"), F.lit("}")))
    for name, fields in node.variants:
        shown = _json_text(F.struct(F.lit(name).alias("x"))) if fields is None else \
            F.to_json(F.struct(json_ready(Rec(fields), value[name]).alias(name)), {"ignoreNullFields": "false"})
        if fields is None:
            shown = F.substring(shown, 6, F.length(shown) - 6)
        text = text.when(value["variant"] == name, shown)
    return F.parse_json(text)


def _json_text(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "false"})


def fields_json(layout: Layout, outcome: Outcome) -> Column:
    """One JSON object per record: fields read so far, NULL for the failed one, nothing after it."""
    if not layout.fields:
        return F.lit("{}")
    whole = _json_text(F.struct(*[json_ready(t, v).alias(n)
                                  for (n, t), v in zip(layout.fields, outcome.values)]))
    pieces = []
    for i, ((name, node), value) in enumerate(zip(layout.fields, outcome.values)):
        one = _json_text(F.struct(json_ready(node, value).alias(name)))
        pieces.append(F.when(F.lit(i) <= outcome.failed_index, F.substring(one, F.lit(2), F.length(one) - 2)))
    part = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return F.when(outcome.failed_index.isNull(), whole).otherwise(part)


# ---- decode -----------------------------------------------------------------

def _fits(layout: Layout) -> bool:
    """Whether expressions can read the layout and print it as JSON."""
    return layout_compiles(layout) and all(renders(t) for _, t in layout.fields if not has_node(t, Unknown))


def _outcome(df: DataFrame, interface: Interface, layout: Layout, data: str, with_json: bool) -> tuple[DataFrame, Outcome, Column]:
    """The rows with what one layout stages, its outcome and its JSON text."""
    df = df.withColumn("_length", F.length(data))
    stages = Stages("_s")
    if _fits(layout) if with_json else layout_compiles(layout):
        outcome = compile_layout(layout, Compiler(F.col(data), F.col("_length"), stages), Pos(None, DISCRIMINATOR_BYTES, 0))
        return stages.apply(df), outcome, fields_json(layout, outcome) if with_json else F.lit(None).cast("string")
    walked, _ = stages.put(walk_column(layout, interface, F.col(data), DISCRIMINATOR_BYTES), 0)
    values = [F.parse_json(walked[f"v{i}"]) if isinstance(spark_type(t), T.VariantType)
              else walked[f"v{i}"] for i, (_, t) in enumerate(layout.fields)]
    outcome = Outcome(values, walked["status"], walked["failed_field"], walked["failed_offset"], walked["trailing"],
                      F.lit(None).cast("int"))
    return stages.apply(df), outcome, walked["json"]


def _outcome_columns(outcome: Outcome) -> list[Column]:
    return [outcome.status.alias("decode_status"), outcome.failed_field.alias("failed_field"),
            outcome.failed_offset.cast("int").alias("failed_offset"),
            outcome.trailing.cast("int").alias("trailing_bytes")]


def decode_table(df: DataFrame, interface: Interface, layout: Layout, data: str = "data",
                 keep: list[str] | None = None, json_column: str | None = None) -> DataFrame:
    """Typed columns of one instruction or account type, with the outcome of each row.

    ``df`` holds payloads of this layout, discriminator included. A record that is
    too short keeps the fields read before the failing one.
    """
    keep = df.columns if keep is None else keep
    staged, outcome, text = _outcome(df, interface, layout, data, json_column is not None)
    names = column_names(layout)
    typed = [v.cast(spark_type(t)).alias(names[i])
             for i, (v, (_, t)) in enumerate(zip(outcome.values, layout.fields))]
    shown = [text.alias(json_column)] if json_column else []
    return staged.select(*keep, *typed, *shown, *_outcome_columns(outcome))


def decode_all(df: DataFrame, interfaces: Interface | list[Interface], kind: str = "instruction",
               data: str = "data", name: str = "name", json_column: str = "args",
               bytes_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every definition of the given programs in a single pass, fields as JSON text.

    Expects dispatched rows (``program_id`` and ``name`` set). Rows without a
    definition get no JSON and status ``unknown``. A lookup, broadcast within ``bytes_limit``, names the shape of
    each row's definition; there is one decoder for each shape, however many definitions have it.
    """
    faces = [interfaces] if isinstance(interfaces, Interface) else interfaces
    chosen: dict[tuple[str, str], tuple[Interface, Layout]] = {}
    for face in faces:
        for layout in face.layouts(kind):
            chosen.setdefault((face.program_id, layout.name), (face, layout))
    found = classify(chosen.values(), _fits)
    rows = _with_shape(df, found, name, bytes_limit).withColumn("_length", F.length(data))

    stages = Stages("_s")
    compiler = Compiler(F.col(data), F.col("_length"), stages)
    reads, fails, indexes, ends = [], [], [], []
    for k, shape in enumerate(found.shapes):
        base, depth = stages.put(F.when(F.col("_shape") == k, F.lit(DISCRIMINATOR_BYTES)), 0)
        got, end = read_shape(shape, compiler, Pos(base, 0, depth))
        reads.append(got)
        ends.append(end.at())
        if got:  # only rows of this shape have a position, so for all others these are NULL
            fails.append(stages.put_word(F.coalesce(*[r.fail for r in got])))
            indexes.append(stages.put_word(F.coalesce(*[F.when(r.fail.isNotNull(), i) for i, r in enumerate(got)])))
    walked = None
    if found.walked:
        walked, _ = stages.put(walk_any(found.walked, F.col("_walk"), F.col(data), DISCRIMINATOR_BYTES), 0)
    none = F.lit(None).cast("int")
    rows = stages.apply(rows).select("*", F.coalesce(*fails, none).alias("_failed"),
                                     F.coalesce(*indexes, "_stop").alias("_failed_index"), F.coalesce(*ends, none).alias("_end"))

    text = F.when(F.col("_shape").isNull(), walked["json"] if walked is not None else F.lit(None).cast("string"))
    for k, (shape, got) in enumerate(zip(found.shapes, reads)):
        text = text.when(F.col("_shape") == k, shape_json(shape, got, F.col("_keys"), F.col("_failed_index"), json_ready))
    shaped = F.col("_shape").isNotNull()
    status = F.when(F.col("_failed").isNotNull(), PARTIAL).when(F.col("_stop").isNotNull(), UNSUPPORTED).otherwise(OK)

    def either(value: Column, of_walked: str) -> Column:
        out = F.when(shaped, value)
        return out if walked is None else out.otherwise(walked[of_walked])

    return rows.select(
        *df.columns, text.alias(json_column),
        F.coalesce(either(status, "status"), F.lit(UNKNOWN)).alias("decode_status"),
        either(F.get("_names", F.col("_failed_index")), "failed_field").alias("failed_field"),
        either(F.coalesce("_failed", F.when(F.col("_stop").isNotNull(), F.col("_end"))).cast("int"), "failed_offset").alias("failed_offset"),
        either(F.when(F.col("_failed").isNull() & F.col("_stop").isNull(), (F.col("_length") - F.col("_end")).cast("int")),
               "trailing").alias("trailing_bytes"))


def _with_shape(df: DataFrame, found: Catalogue, name: str, bytes_limit: int) -> DataFrame:
    """Adds to each row the shape of its definition, or its number for the walker, and the names. Rows without a match are
    named ``unknown``, which a definition may be called too, so ``matched`` decides where the table has it."""
    kind = df.schema["program_id"].dataType
    key = key_bytes if isinstance(kind, T.BinaryType) else str
    schema = T.StructType([T.StructField("program_id", kind), T.StructField(name, T.StringType()),
                           T.StructField("_shape", T.IntegerType()), T.StructField("_walk", T.IntegerType()),
                           T.StructField("_names", T.ArrayType(T.StringType())), T.StructField("_keys", T.ArrayType(T.StringType())),
                           T.StructField("_stop", T.IntegerType())])
    size = sum(100 + 4 * len(row[1]) + sum(16 + 4 * len(n) for n in (*row[4], *row[5])) for row in found.rows)
    lookup = df.sparkSession.createDataFrame([(key(row[0]), *row[1:]) for row in found.rows], schema)
    rows = attach_small(df, lookup, ["program_id", name], bytes_limit, known_bytes=size)
    if "matched" not in df.columns:
        return rows
    return rows.withColumns({c: F.when(F.col("matched"), F.col(c)) for c in ("_shape", "_walk", "_stop")})


def args_variant(text: Column, json_null: bool = False) -> Column:
    """Arguments as VARIANT. Unknown instructions have SQL NULL, or a JSON null where that is wanted."""
    parsed = F.parse_json(text)
    return F.coalesce(parsed, F.parse_json(F.lit("null"))) if json_null else parsed


def publish_instructions(decoded: DataFrame, indexed_at: Column | None = None, json_null: bool = False) -> DataFrame:
    """Decoded rows as the published instructions table: keys become text here, at the very end."""
    stamp = F.current_timestamp() if indexed_at is None else indexed_at
    return decoded.select(
        "transaction_signature", "slot", "outer_index", "inner_index", "instruction_index",
        F.col("name").alias("instruction_name"), base58(F.col("program_id")).alias("program_id"),
        args_variant(F.col("args"), json_null).alias("args"), base58_list(F.col("accounts")).alias("accounts"),
        F.col("data").alias("raw_data"), "decode_status", stamp.alias("indexed_at"))


def decode_ledger(raw: DataFrame, interfaces: list[Interface]) -> DataFrame:
    """Raw transactions to decoded instructions of the given programs, on tables and streams alike.

    Other programs' instructions are dropped before anything is matched or decoded;
    the whole chain is narrow.
    """
    flat = flatten_instructions(raw)
    ours = flat.where(F.col("program_id").isin([key_bytes(face.program_id) for face in interfaces]))
    return decode_all(dispatch(ours, interfaces), interfaces)


def program_literal(df: DataFrame, interface: Interface) -> Column:
    """The program's id in the form the table holds it: key bytes or text."""
    if isinstance(df.schema["program_id"].dataType, T.BinaryType):
        return key_literal(interface.program_id)
    return F.lit(interface.program_id)


def _matches(df: DataFrame, interface: Interface, layout: str, name: str = "name") -> Column:
    """Rows of one definition. Rows without a match are named ``unknown``, which a definition may be called too, so
    ``matched`` decides where the table has it."""
    same = (F.col(name) == layout) & (F.col("program_id") == program_literal(df, interface))
    return same & F.col("matched") if "matched" in df.columns else same


def typed_instructions(dispatched: DataFrame, interface: Interface, name: str, data: str = "data",
                       indexed_at: Column | None = None) -> DataFrame:
    """Rows of one ``{program}_ix_{name}`` table; an instruction without arguments still gives its row."""
    layout = interface.find("instruction", name)
    key = ["transaction_signature", "outer_index", "inner_index", "instruction_index"]
    rows = dispatched.where(_matches(dispatched, interface, name))
    decoded = decode_table(rows.select(*key, data), interface, layout, data, keep=key)
    return decoded.withColumn("indexed_at", F.current_timestamp() if indexed_at is None else indexed_at)


def typed_accounts(dispatched: DataFrame, interface: Interface, name: str, data: str = "data",
                   keep: list[str] | None = None) -> DataFrame:
    """Rows of one account table: typed fields and the whole object as JSON in ``data_json``."""
    layout = interface.find("account", name)
    keep = keep or [c for c in dispatched.columns if c not in (data, "name", "matched", "fields")]
    rows = dispatched.where(_matches(dispatched, interface, name))
    return decode_table(rows, interface, layout, data, keep=keep, json_column="data_json")


def derived_rows(dispatched: DataFrame, interface: Interface, layout: Layout, data: str = "data",
                 source: str = "tx", observed_at: Column | None = None, indexed_at: Column | None = None) -> DataFrame:
    """Rows of one type's table, with exactly the schema that is derived for it.

    Key columns come from ``dispatched`` by name and are NULL where it has none; an account's whole object is ``data``
    as VARIANT. ``observed_at`` is taken from the rows unless it is given.
    """
    schema = typed_schema(layout)
    rows = dispatched.where(_matches(dispatched, interface, layout.name))
    keep = [f.name for f in schema if f.name in rows.columns and f.name != data and f.name not in column_names(layout).values()]
    whole = "_json" if layout.kind == "account" else None
    decoded = decode_table(rows.select(*keep, data), interface, layout, data, keep=keep, json_column=whole)
    given = {"source": F.lit(source), "indexed_at": F.current_timestamp() if indexed_at is None else indexed_at}
    if whole:
        given["data"] = F.parse_json(whole)
    if observed_at is not None:
        given["observed_at"] = observed_at
    return decoded.select(*[given.get(f.name, F.col(f.name) if f.name in decoded.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in schema])


def write_derived(dispatched: DataFrame, interface: Interface, path: str, batch_id: int, kind: str = "instruction",
                  data: str = "data", source: str = "tx", observed_at: Column | None = None, indexed_at: Column | None = None) -> list[str]:
    """One batch into the derived tables ``{path}/{table}`` of a program; returns the tables it had rows for.

    The batch is evaluated and dealt out by type once; each type is then decoded from its own part. Tables have a
    manifest each, and a table that has the batch already is left as it is.
    """
    spark, aside = dispatched.sparkSession, f"{path}/_dealt/batch={batch_id}"
    rows = dispatched.where((F.col("program_id") == program_literal(dispatched, interface)) & F.col("matched"))
    rows.withColumn("_type", F.col("name")).hint("rebalance", "_type").write.mode("overwrite").partitionBy("_type").parquet(aside)
    dealt = spark.read.schema(T.StructType([*rows.schema, T.StructField("_type", T.StringType())])).parquet(aside)
    wanted, written = {n for n in manifest.names_in(spark, aside) if n.startswith("_type=")}, []
    for layout in interface.layouts(kind):
        if f"_type={quote(layout.name)}" not in wanted and f"_type={layout.name}" not in wanted:
            continue
        part = dealt.where(F.col("_type") == layout.name).drop("_type")
        manifest.append(derived_rows(part, interface, layout, data, source, observed_at, indexed_at), f"{path}/{table_name(layout)}", batch_id)
        written.append(table_name(layout))
        wanted -= {f"_type={quote(layout.name)}", f"_type={layout.name}"}
    return written


def read_derived(spark: SparkSession, layout: Layout, path: str) -> DataFrame:
    """One type's table, with the schema derived for it."""
    schema = typed_schema(layout)
    return manifest.read(spark, f"{path}/{table_name(layout)}", schema).select(*schema.names)


def populate(text: Column, schema: T.StructType, keys: list[str] | None = None) -> Column:
    """A typed struct from a JSON object, by column name.

    ``keys`` lists the JSON keys to look for. They are matched on sanitised names,
    so ``lastSlot`` fills a column ``lastslot``. Without it keys equal column names.
    """
    keys = keys or schema.fieldNames()
    by_name = {sanitize_name(k): k for k in keys}
    source = T.StructType([T.StructField(by_name.get(f.name, f.name), f.dataType) for f in schema])
    parsed = F.from_json(text, source)
    return F.struct(*[parsed[s.name].alias(f.name) for s, f in zip(source, schema)])


def quarantine(decoded: DataFrame) -> DataFrame:
    """Records that did not decode completely; they stay in their tables as well."""
    return decoded.where(F.col("decode_status") != OK)


def decode_report(decoded: DataFrame, by: tuple[str, ...] = ("program_id", "name")) -> DataFrame:
    """How many records ended in which state."""
    return decoded.groupBy(*by, "decode_status").agg(F.count("*").alias("records"))
