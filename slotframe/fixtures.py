"""The given tables seen as ledger records, and encoders for binary payloads.

The encoders are written apart from the decoders; encoding given columns and
decoding them again must return the columns.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe.functions.base58 import encode_values
from slotframe.functions.names import account_discriminator, instruction_discriminator
from slotframe.plans.types import Interface, parse_interface
from slotframe.session import new_path
from slotframe.streaming.sources import file_stream


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream, whether it is one file or a folder of files."""
    static = table(spark, sf, name)
    single = static.inputFiles()[0].endswith(f"/{name}.parquet")
    if single:
        return file_stream(spark, sf, static.schema, name_filter=f"{name}.parquet")
    return file_stream(spark, f"{sf}/{name}.parquet", static.schema)


LANDED_ROWS = 100_000
"""Rows of a landed file, as far as one task should read."""


def landed_stream(turns: list[DataFrame], label: str) -> DataFrame:
    """Rows that land one turn after the other, as a stream with a micro-batch for each turn. Every turn has the same number
    of files, as many as the largest needs, so that a micro-batch is one turn and many tasks read it."""
    spark, schema = turns[0].sparkSession, turns[0].schema
    path, files = new_path(spark, label), -(-max(1, *[turn.count() for turn in turns]) // LANDED_ROWS)
    for turn in turns:
        (turn.repartition(files) if files > 1 else turn.coalesce(1)).write.mode("append").parquet(path)
    return file_stream(spark, path, schema, files_per_trigger=files)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all available files into a folder and returns what it wrote."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    (stream.writeStream.format("parquet").option("path", f"{path}/rows")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


# ---- encoders ---------------------------------------------------------------

SWAP = 0x0F0F0F0F0F0F0F0F


def le(value: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer, lowest first."""
    number = value.cast("bigint")
    swapped = F.shiftleft(number.bitwiseAND(F.lit(SWAP)), 4).bitwiseOR(
        F.shiftrightunsigned(number, 4).bitwiseAND(F.lit(SWAP)))
    return F.substring(F.unhex(F.reverse(F.lpad(F.hex(swapped), 16, "0"))), 1, size)


def pack(*pairs: tuple[Column, str]) -> Column:
    """Columns without NULLs side by side as BINARY, given with their NumPy codes (``<u8``, ``<f4``, ...)."""
    layout = np.dtype([(f"f{i}", code) for i, (_, code) in enumerate(pairs)])

    @F.arrow_udf(T.BinaryType())
    def packed(*columns: pa.Array) -> pa.Array:
        rows = np.empty(len(columns[0]), dtype=layout)
        for name, column in zip(layout.names, columns):
            rows[name] = column.to_numpy(zero_copy_only=False).astype(layout[name])
        ends = np.arange(len(rows) + 1, dtype=np.int32) * layout.itemsize
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])

    return packed.asNondeterministic()(*[column for column, _ in pairs])


@F.arrow_udf(T.BinaryType())
def _float_list_bytes(values: pa.Array) -> pa.Array:
    return pa.array([np.asarray(v, dtype="<f4").tobytes() for v in values.to_pylist()], pa.binary())


def f32_list_bytes(values: Column) -> Column:
    return _float_list_bytes.asNondeterministic()(values)


def text_bytes(text: Column) -> Column:
    raw = text.cast("binary")
    return F.concat(le(F.length(raw), 4), raw)


def option_bytes(value: Column, encoded: Column) -> Column:
    return F.when(value.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), encoded))


@F.arrow_udf(T.BinaryType())
def _zlib_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(t.encode()) for t in texts.to_pylist()], pa.binary())


def key32(text: Column) -> Column:
    """A 32-byte key made from text."""
    return F.unhex(F.sha2(text, 256))


def key32_of(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


# ---- definitions ------------------------------------------------------------

DESK, PRICES = key32_of("desk"), key32_of("prices")


def _args(**kinds: object) -> list:
    return [{"name": n, "type": t} for n, t in kinds.items()]


def desk_document() -> dict:
    return {"address": encode_values([DESK])[0], "metadata": {"name": "desk"}, "instructions": [
        {"name": "placeOrder", "args": _args(order="u64", customer="u64"),
         "accounts": [{"name": "customer", "writable": True}, {"name": "order", "writable": True},
                      {"name": "extra", "writable": True}]},
        {"name": "note", "args": _args(text="string", order="u64"),
         "accounts": [{"name": "order"}, {"name": "customer", "isMut": True}]}]}


def prices_document() -> dict:
    return {"address": encode_values([PRICES])[0], "metadata": {"name": "prices"}, "instructions": [
        {"name": "price", "args": _args(amount="u64"), "accounts": [{"name": "subject", "writable": True}]}]}


def one_layout(name: str, fields: list, types: list = ()) -> Interface:
    """A definition with a single instruction."""
    return parse_interface({"address": "fixture", "metadata": {"name": "fixture"}, "types": list(types),
                            "instructions": [{"name": name, "args": fields}]})


def disc(name: str) -> Column:
    return instruction_discriminator(F.lit(name))


# ---- views ------------------------------------------------------------------

def transactions(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("signature"), F.col("o_orderkey").alias("slot"),
        F.col("o_orderdate").alias("block_time"), (~failed).alias("success"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("fee"),
        F.when(failed, F.col("o_orderpriority")).alias("err_msg"))


def instructions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("transaction_signature"), F.col("l_orderkey").alias("slot"),
        F.col("l_linenumber").alias("outer_index"), F.lit(None).cast("int").alias("inner_index"),
        F.col("l_linenumber").alias("instruction_index"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("instruction_name"),
        F.col("l_suppkey").cast("string").alias("program_id"), F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("indexed_at"))


def raw_transactions_of(orders: DataFrame) -> DataFrame:
    """Orders as nested raw transactions: three instructions each, some calling others."""
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    failed = F.col("o_orderstatus") == "F"

    def ix(program: Column, accounts: list[int], data: Column) -> Column:
        return F.struct(program.cast("int").alias("program_index"),
                        F.array(*[F.lit(a) for a in accounts]).alias("account_indices"), data.alias("data"))

    price = F.concat(disc("price"), le(customer, 8))
    keys = F.array(key32(F.concat(F.lit("c"), customer)), key32(F.concat(F.lit("o"), order)), F.lit(DESK),
                   F.lit(PRICES), key32(F.col("o_orderpriority")))
    message = F.struct(keys.alias("account_keys"), F.array(
        ix(F.lit(2), [0, 1, 9], F.concat(disc("placeOrder"), le(order, 8), le(customer, 8))),
        ix(F.lit(3), [1], F.concat(disc("price"), le(F.round(F.col("o_totalprice") * 100), 8))),
        ix(F.when(failed, 7).otherwise(2), [1, 0],
           F.concat(disc("note"), text_bytes(F.col("o_orderpriority")), le(order, 8)))).alias("instructions"))
    called = F.struct(F.lit(0).alias("outer_index"),
                      F.array(ix(F.lit(3), [0], price), ix(F.lit(2), [4], F.lit(b"\x01"))).alias("instructions"))
    also = F.struct(F.lit(2).alias("outer_index"), F.array(ix(F.lit(3), [4], price)).alias("instructions"))
    inner = F.when(F.col("o_orderstatus") == "O", F.array(also, called)).otherwise(F.array(called))
    return orders.select(
        order.cast("string").alias("signature"), order.alias("slot"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("block_time"),
        (F.col("o_orderstatus") == "P").alias("is_vote"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "processed")
        .when(F.col("o_orderpriority") == "2-HIGH", "finalized").otherwise("confirmed").alias("commitment"),
        F.when(failed, F.col("o_orderpriority")).alias("err"),
        F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)").alias("fee"),
        message.alias("message"), inner.alias("inner"))


def raw_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return raw_transactions_of(table(spark, sf, "orders"))


def wire_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return wire_transactions_of(table(spark, sf, "orders"))


def wire_transactions_of(orders: DataFrame) -> DataFrame:
    """Raw transactions as base64 wire bytes; those of urgent orders are broken in two ways."""
    raw = raw_transactions_of(orders)

    def compact(n: Column) -> Column:
        return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2, "0"))

    def joined(parts: Column) -> Column:
        return F.unhex(F.array_join(parts, ""))

    m = F.col("message")
    ixs = joined(F.transform(m["instructions"], lambda i: F.hex(F.concat(
        compact(i["program_index"]), compact(F.size(i["account_indices"])),
        F.unhex(F.array_join(F.transform(i["account_indices"], lambda a: F.lpad(F.hex(a), 2, "0")), "")),
        compact(F.length(i["data"])), i["data"]))))
    signature = F.unhex(F.concat(F.sha2("signature", 256), F.sha2("signature", 256)))
    wire = F.concat(F.lit(b"\x01"), signature, F.lit(b"\x01\x00\x02"), compact(F.size(m["account_keys"])),
                    joined(F.transform(m["account_keys"], lambda k: F.hex(k))), key32(F.lit("block")),
                    compact(F.size(m["instructions"])), ixs)
    text = F.base64(wire)
    odd = F.col("slot") % 2 == 1
    broken = F.when(odd, F.lit("***")).otherwise(F.base64(F.substring(wire, 1, 90)))
    urgent = F.col("commitment") == "processed"
    return raw.select("signature", "slot", "block_time", "err", "fee", "commitment",
                      F.when(urgent, broken).otherwise(text).alias("wire_base64"))


FILL = one_layout("fill", _args(order="u64", line="u8", part="u64", supplier="u64", quantity="f64", price="f64",
                                discount="f64", tax="f64"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def fill_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as fixed-size binary payloads."""
    kinds = {"l_orderkey": "<i8", "l_linenumber": "<u1", "l_partkey": "<i8", "l_suppkey": "<i8", "l_quantity": "<f8",
             "l_extendedprice": "<f8", "l_discount": "<f8", "l_tax": "<f8"}
    body = pack(*[(F.col(c), code) for c, code in kinds.items()])
    return lines(spark, sf).select(F.concat(disc("fill"), body).alias("data"))


CUT = one_layout("cut", _args(order="u64", line="u8", part="u32", supplier="i64"))


def cut_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as payloads that end early, right on time, or late, by line number."""
    body = pack(*[(F.col(c), code) for c, code in (("l_orderkey", "<i8"), ("l_linenumber", "<u1"),
                                                   ("l_partkey", "<u4"), ("l_suppkey", "<i8"))])
    whole = F.concat(disc("cut"), body, F.lit(b"\xff" * 14))
    return lines(spark, sf).select(
        F.substring(whole, F.lit(1), F.lit(8) + F.col("l_linenumber") * 5).alias("data"))


NUMBERS = one_layout("numbers", _args(
    open="bool", a="u8", b="i8", c="u16", d="i16", e="u32", f="i32", g="u64", h="i64"))


def number_payloads(spark: SparkSession, sf: str) -> DataFrame:
    line, part, order = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_orderkey")
    first = pack((F.when(F.col("l_linestatus") == "O", 2).otherwise(0), "<u1"), (line + 200, "<u1"), (-line, "<i1"),
                 (part % 65536, "<u2"), (-(part % 32768), "<i2"), (part + 3000000000, "<u4"), (-part, "<i4"))
    large = F.concat(F.substring(le(order, 8), 1, 7), F.lit(b"\x80"))
    return lines(spark, sf).select(F.concat(disc("numbers"), first, large, le(-order, 8)).alias("data"))


WIDE = one_layout("wide", _args(order="u64", u="u128", i="i128"))


def wide_payloads(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.unhex(F.md5(F.col("o_orderkey").cast("string")))
    return table(spark, sf, "orders").select(
        F.concat(disc("wide"), le(F.col("o_orderkey"), 8), digest, digest).alias("data"))


FLOATS = one_layout("floats", _args(price="f64", negative="f64", small="f32", rate="f32"))


def float_payloads(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    body = pack((price, "<f8"), (-price * F.col("l_discount"), "<f8"), (price, "<f4"), (F.col("l_tax"), "<f4"))
    return lines(spark, sf).select(F.concat(disc("floats"), body).alias("data"))


TEXTS = one_layout("texts", _args(doc="u64", text="string", lang={"option": "string"}, raw="bytes", n="i64"))


def text_payloads(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf, "documents").select(F.concat(
        disc("texts"), le(F.col("doc_id"), 8), text_bytes(F.col("text")), option_bytes(lang, text_bytes(lang)),
        text_bytes(F.col("source")), le(-F.col("n_chars"), 8)).alias("data"))


OPTIONS = one_layout("options", _args(doc="u64", quality={"option": "u8"}, toxic={"option": {"option": "i32"}}, end="u8"))


def option_payloads(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    quality, toxic = F.col("quality"), F.col("toxic")
    return both.select(F.concat(
        disc("options"), le(F.col("doc_id"), 8), option_bytes(quality, le(quality, 1)),
        F.concat(F.lit(b"\x07"), option_bytes(toxic, le(-toxic, 4))), F.lit(b"\x2a")).alias("data"))


VECTORS = one_layout("vectors", _args(id="u64", items={"vec": "f32"}, label="i32"))
ARRAYS = one_layout("arrays", _args(id="u64", items={"array": ["f32", 64]}, label="i32"))


def vector_payloads(spark: SparkSession, sf: str, counted: bool) -> DataFrame:
    items = f32_list_bytes(F.col("embedding"))
    count = [le(F.size("embedding"), 4)] if counted else []
    return table(spark, sf, "embeddings").select(F.concat(
        disc("vectors" if counted else "arrays"), le(F.col("vec_id"), 8), *count, items,
        le(F.col("label"), 4)).alias("data"))


TURN_TYPES = [
    {"name": "Role", "type": {"kind": "enum", "variants": [{"name": "user"}, {"name": "assistant"}]}},
    {"name": "Body", "type": {"kind": "enum", "variants": [
        {"name": "Plain"}, {"name": "Said", "fields": _args(turn="u32", text="string")}]}}]
TURNS = one_layout("turns", _args(conv="u64", role={"defined": {"name": "Role"}},
                                  body={"defined": {"name": "Body"}}), TURN_TYPES)


def turn_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns; ``system`` has no variant of its own and becomes index 9."""
    role = F.when(F.col("role") == "user", F.lit(b"\x00")).when(F.col("role") == "assistant", F.lit(b"\x01")) \
        .otherwise(F.lit(b"\x09"))
    said = F.concat(F.lit(b"\x01"), le(F.col("turn"), 4), text_bytes(F.col("text")))
    body = F.when(F.col("role") == "system", F.lit(b"\x00")).otherwise(said)
    return table(spark, sf, "conversations").select(
        F.concat(disc("turns"), le(F.col("conv_id"), 8), role, body).alias("data"))


WALLET_KINDS = ("Click", "View", "Purchase", "Signup")  # "Error" has no definition


def wallet_document() -> dict:
    return {"address": "wallets", "metadata": {"name": "wallets"}, "instructions": [],
            "accounts": [{"name": k} for k in WALLET_KINDS],
            "types": [{"name": k, "type": {"kind": "struct", "fields": _args(
                k="u32", value="f64", label={"option": "string"})}} for k in WALLET_KINDS]}


def raw_accounts_of(events: DataFrame) -> DataFrame:
    """Events as account states: one account per user and kind."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.initcap("event_type")
    data = F.concat(account_discriminator(kind), pack((F.coalesce(k, F.lit(0)), "<u4"), (F.col("value"), "<f8")),
                    option_bytes(F.when(k > 50, kind), text_bytes(kind)))
    return events.select(
        F.col("user_id").cast("string").alias("pubkey"), F.lit("wallets").alias("owner"), data.alias("data"),
        F.col("event_id").alias("slot"), F.col("ts").alias("observed_at"))


def account_states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.lit("wallets").alias("program"), F.col("event_type").alias("account_type"),
        F.col("user_id").cast("string").alias("pubkey"), F.col("event_id").alias("slot"),
        F.col("ts").alias("observed_at"), F.col("props").alias("data"), "value")


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"),
        (k % 10 != 0).alias("ok"), F.col("event_id").alias("slot"), F.date_trunc("day", "ts").alias("day"))


def part_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One interface definition per part, as (program_id, json)."""
    brand = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("Set"))
    account = F.initcap("p_type")
    field = F.struct(F.lit("unitPrice").alias("name"), F.lit("u64").alias("type"))
    struct_type = F.struct(F.lit("struct").alias("kind"), F.array(field).alias("fields"))
    meta = F.struct(F.lit("owner").alias("name"), F.lit(True).alias("writable"), F.lit(None).cast("boolean").alias("isMut"))
    plain = F.struct(F.lit("peer").alias("name"), F.lit(False).alias("writable"), F.lit(None).cast("boolean").alias("isMut"))
    old = F.struct(F.lit("book").alias("name"), F.lit(None).cast("boolean").alias("writable"), F.lit(True).alias("isMut"))
    arg = F.struct(F.lit("slot").alias("name"), F.lit("u16").alias("type"))
    given = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(i * F.col("p_size"), F.lit(256)))
    ixs = F.array(
        F.struct(brand.alias("name"), F.lit(None).cast("array<int>").alias("discriminator"),
                 F.array(meta, plain, old).alias("accounts"), F.array(arg).alias("args")),
        F.struct(F.lit("HTTPServer").alias("name"), given.alias("discriminator"),
                 F.lit(None).cast("array<struct<name:string,writable:boolean,isMut:boolean>>").alias("accounts"),
                 F.lit(None).cast("array<struct<name:string,type:string>>").alias("args")))
    document = F.to_json(F.struct(
        F.struct(F.col("p_name").alias("name")).alias("metadata"), ixs.alias("instructions"),
        F.array(F.struct(account.alias("name"))).alias("accounts"),
        F.array(F.struct(account.alias("name"), struct_type.alias("type"))).alias("types")))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("program_id"),
                                           document.alias("json"), "p_size")


def part_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """The same definitions as compressed account blobs; small parts give a cut-off blob."""
    body = _zlib_bytes(F.col("json"))
    blob = F.concat(F.lit(bytes(8)), key32(F.col("program_id")), le(F.length("body"), 4), F.col("body"))
    cut = F.when(F.col("p_size") < 5, F.substring(blob, 1, 44)) \
        .when(F.col("p_size") < 9, F.substring(blob, F.lit(1), F.length(blob) - 6)).otherwise(blob)
    return part_documents(spark, sf).withColumn("body", body).select("program_id", cut.alias("data"))


def supplier_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One program per supplier; the combination N/O has no definition."""
    names = [f"fill_{a}{b}" for a in "anr" for b in "fo" if a + b != "no"]
    document = json.dumps({"metadata": {"name": "shop"}, "instructions": [
        {"name": n, "args": _args(order="u64")} for n in names]})
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("program_id"),
                                               F.lit(document).alias("json"))


def shop_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as payloads of their supplier's program; seventh lines are too short to match."""
    name = F.concat(F.lit("fill_"), F.lower("l_returnflag"), F.lower("l_linestatus"))
    data = F.concat(instruction_discriminator(name), le(F.col("l_orderkey"), 8))
    return lines(spark, sf).select(
        F.col("l_suppkey").cast("string").alias("program_id"),
        F.when(F.col("l_linenumber") == 7, F.substring(data, 1, 7)).otherwise(data).alias("data"))


MILL_LAYOUTS = 132


def mill_document() -> dict:
    """A program with many instructions of few shapes; no two of them share a name, inner names included."""
    def fields(i: int) -> list:
        a, b = f"first{i}", f"second{i}"
        kinds = [{}, {a: "u64"}, {a: "string", b: "u64"}, {a: "u64", b: "string"}, {a: "bool", b: "u8"}, {a: {"option": "u64"}},
                 {a: {"vec": "u16"}, b: "i32"}, {a: {"defined": {"name": f"Box{i}"}}}, {a: {"defined": f"Kind{i}"}, b: "u8"},
                 {a: "i64", b: "u32"}, {a: {"array": ["u32", 2]}}, {a: {"vec": {"defined": f"Box{i}"}}}]
        return _args(**kinds[i % len(kinds)])

    types = []
    for i in range(MILL_LAYOUTS):
        types += [{"name": f"Box{i}", "type": {"kind": "struct", "fields": _args(**{f"wide{i}": "u32", f"flag{i}": "bool"})}},
                  {"name": f"Kind{i}", "type": {"kind": "enum", "variants": [
                      {"name": f"Off{i}"}, {"name": f"On{i}", "fields": _args(**{f"by{i}": "u16"})}]}}]
    return {"address": "mill", "metadata": {"name": "mill"}, "types": types,
            "instructions": [{"name": f"step{i}", "args": fields(i)} for i in range(MILL_LAYOUTS)]}


def mill_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as calls of the program above, one instruction after the other."""
    step, key, size = F.col("p_partkey") % MILL_LAYOUTS, F.col("p_partkey"), F.col("p_size")
    odd = size % 2 == 1
    box = F.concat(le(key, 4), F.when(odd, F.lit(b"\x01")).otherwise(F.lit(b"\x00")))
    bodies = [F.lit(b""), le(key, 8), F.concat(text_bytes(F.col("p_name")), le(key, 8)),
              F.concat(le(key, 8), text_bytes(F.col("p_brand"))), F.concat(F.when(odd, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), le(size, 1)),
              F.when(odd, F.concat(F.lit(b"\x01"), le(key, 8))).otherwise(F.lit(b"\x00")),
              F.concat(F.lit(b"\x02\x00\x00\x00"), le(size, 2), le(size + 1, 2), le(-size, 4)), box,
              F.when(odd, F.concat(F.lit(b"\x01"), le(size, 2), le(size, 1))).otherwise(F.concat(F.lit(b"\x00"), le(size, 1))),
              F.concat(le(-key, 8), le(size, 4)), F.concat(le(key, 4), le(size, 4)), F.concat(F.lit(b"\x02\x00\x00\x00"), box, box)]
    body = F.lit(None).cast("binary")
    for i, chosen in enumerate(bodies):
        body = F.when(step % len(bodies) == i, chosen).otherwise(body)
    name = F.concat(F.lit("step"), step.cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.lit("mill").alias("program_id"),
                                           F.concat(instruction_discriminator(name), body).alias("data"))
