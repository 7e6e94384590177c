"""Every operator as a query over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotframe import fixtures as fx
from slotframe.functions import names
from slotframe.functions.base58 import base58 as to_base58
from slotframe.functions.base58 import encode_values
from slotframe.functions.base58 import unbase58
from slotframe.functions.times import rfc3339
from slotframe.functions.wire import base64_bytes
from slotframe.operators import decode as dc
from slotframe.operators import flatten as fl
from slotframe.operators import health, lookups, queries, tables
from slotframe.operators.dispatch import dispatch
from slotframe.plans.schemas import schema_table, table_name, type_name
from slotframe.plans.types import Interface, parse_interface
from slotframe.session import new_path
from slotframe.sources import definitions as df_
from slotframe.sources import ledger
from slotframe.sources.messages import unpack_messages
from slotframe.streaming import buckets, counts, ingest, pending, snapshot
from slotframe.streaming import sources as ss
from slotframe.streaming.sources import file_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return keep


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


# ---- SQL pieces -------------------------------------------------------------

SQL_TX = """tx AS (SELECT CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot, o_orderdate AS block_time,
    o_orderstatus <> 'F' AS success, CAST(round(o_totalprice * 100) AS BIGINT) AS fee,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS err_msg FROM orders)"""
SQL_IX = """ix AS (SELECT CAST(l_orderkey AS VARCHAR) AS transaction_signature, l_orderkey AS slot,
    l_linenumber AS outer_index, l_linenumber AS instruction_index,
    l_returnflag || '_' || l_linestatus AS instruction_name, CAST(l_suppkey AS VARCHAR) AS program_id,
    l_partkey AS part, l_extendedprice AS price, l_shipdate AS indexed_at FROM lineitem)"""


def sql_le(value: str, size: int) -> str:
    """Little-endian hex of an integer, in SQL."""
    digits = f"lpad(lower(hex(CAST({value} AS BIGINT))), 16, '0')"
    return " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(size))


def sql_disc(name: str) -> str:
    return f"substr(sha256('global:{name}'), 1, 16)"


DESK_HEX, PRICES_HEX = fx.DESK.hex(), fx.PRICES.hex()
SQL_KEY_C = "sha256('c' || CAST(o_custkey AS VARCHAR))"
SQL_KEY_O = "sha256('o' || CAST(o_orderkey AS VARCHAR))"
SQL_KEY_P = "sha256(o_orderpriority)"
SQL_PLACE = f"{sql_disc('place_order')} || {sql_le('o_orderkey', 8)} || {sql_le('o_custkey', 8)}"
SQL_AMOUNT = f"{sql_disc('price')} || {sql_le('round(o_totalprice * 100)', 8)}"
SQL_PRICE = f"{sql_disc('price')} || {sql_le('o_custkey', 8)}"
SQL_NOTE = (f"{sql_disc('note')} || {sql_le('length(o_orderpriority)', 4)} || lower(hex(o_orderpriority)) || "
            f"{sql_le('o_orderkey', 8)}")
SQL_FLAT = f"""flat AS (
  SELECT o.*, 0 AS outer_index, CAST(NULL AS INTEGER) AS inner_index, 0 AS instruction_index,
    '{DESK_HEX}' AS program, {SQL_KEY_C} || ',' || {SQL_KEY_O} || ',-' AS accounts, {SQL_PLACE} AS data,
    'placeOrder' AS name FROM orders o
  UNION ALL SELECT o.*, 0, 0, 0, '{PRICES_HEX}', {SQL_KEY_C}, {SQL_PRICE}, 'price' FROM orders o
  UNION ALL SELECT o.*, 0, 1, 1, '{DESK_HEX}', {SQL_KEY_P}, '01', 'unknown' FROM orders o
  UNION ALL SELECT o.*, 1, NULL, 1, '{PRICES_HEX}', {SQL_KEY_O}, {SQL_AMOUNT}, 'price' FROM orders o
  UNION ALL SELECT o.*, 2, NULL, 2, CASE WHEN o_orderstatus <> 'F' THEN '{DESK_HEX}' END,
    {SQL_KEY_O} || ',' || {SQL_KEY_C}, {SQL_NOTE}, CASE WHEN o_orderstatus <> 'F' THEN 'note' ELSE 'unknown' END FROM orders o
  UNION ALL SELECT o.*, 2, 0, 2000, '{PRICES_HEX}', {SQL_KEY_P}, {SQL_PRICE}, 'price' FROM orders o
    WHERE o_orderstatus = 'O')"""


def flat(spark: SparkSession, sf: str) -> DataFrame:
    return fl.flatten_instructions(fx.raw_transactions(spark, sf))


def dispatched(spark: SparkSession, sf: str) -> DataFrame:
    return dispatch(flat(spark, sf), [desk(), parse_interface(fx.prices_document())])


def desk() -> Interface:
    return parse_interface(fx.desk_document())


def decoded_one(df: DataFrame, interface: Interface, **kw: object) -> DataFrame:
    return dc.decode_table(df, interface, interface.instructions[0], keep=[], **kw)


def minus(name: str) -> Column:
    """A nullable integer with -1 for NULL, so that results compare as plain integers."""
    return F.coalesce(F.col(name), F.lit(-1)).alias(name)


def key_text(keys: Column) -> Column:
    """Account keys as one text, ``-`` where a key is missing."""
    return F.array_join(F.transform(keys, lambda k: F.coalesce(hexed(k), F.lit("-"))), ",")


# ---- scans ------------------------------------------------------------------

@query(f"WITH {SQL_TX} SELECT * FROM tx WHERE slot BETWEEN 200 AND 4000000000")
def scan_slots(spark, sf):
    return ledger.scan_slots(fx.transactions(spark, sf), 200, 4000000000)


SQL_WANTED = "wanted AS (SELECT DISTINCT CAST(c_custkey * 20 AS VARCHAR) AS signature FROM customer)"


def wanted(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "customer").select((F.col("c_custkey") * 20).cast("string").alias("signature"))


@query(f"WITH {SQL_TX}, {SQL_WANTED} SELECT * FROM tx WHERE signature IN (SELECT signature FROM wanted)")
def lookup_found(spark, sf):
    return ledger.lookup_signatures(fx.transactions(spark, sf), wanted(spark, sf))[0]


@query(f"WITH {SQL_TX}, {SQL_WANTED} SELECT signature FROM wanted WHERE signature NOT IN (SELECT signature FROM tx)")
def lookup_missing(spark, sf):
    return ledger.lookup_signatures(fx.transactions(spark, sf), wanted(spark, sf))[1]


@query(f"WITH {SQL_TX} SELECT * FROM tx WHERE (slot, signature) > (700, '700')")
def backfill_since(spark, sf):
    return ledger.backfill(fx.transactions(spark, sf), (700, "700"), oldest_first=True)


@query(f"""WITH {SQL_TX} SELECT * FROM tx 
WHERE (slot < 1200 OR (slot = 1200 AND signature < '1200')) AND (slot > 10 OR (slot = 10 AND signature > '10'))
ORDER BY slot DESC, signature DESC LIMIT 100""")
def keyset_page(spark, sf):
    return ledger.keyset_page(fx.transactions(spark, sf), 100, (1200, "1200"), (10, "10"))


def raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_transactions_of(fx.table_stream(spark, sf, "orders"))
    return raw.withColumn("account_keys", F.col("message.account_keys"))


MENTIONED = [fx.key32_of("1-URGENT"), fx.key32_of("5-LOW"), fx.key32_of("c17")]


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') OR o_custkey = 17""")
def stream_mentions(spark, sf):
    return fx.drain(ss.stream_program(raw_stream(spark, sf), MENTIONED).select("signature", "slot"), "mentions")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot FROM orders
WHERE (o_orderpriority IN ('1-URGENT', '5-LOW') OR o_custkey = 17)
  AND o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'""")
def stream_filter(spark, sf):
    rows = ss.stream_filter(raw_stream(spark, sf), vote=False, failed=False, include=MENTIONED, commitment="confirmed")
    return fx.drain(rows.select("signature", "slot"), "filtered")


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table_stream(spark, sf, "events")
    return events.select((F.col("event_id") * 3).cast("string").alias("signature"))


@query(f"""WITH {SQL_TX} SELECT tx.* FROM events JOIN tx ON tx.signature = CAST(event_id * 3 AS VARCHAR)""")
def enrich(spark, sf):
    return fx.drain(ss.enrich_notifications(notifications(spark, sf), fx.transactions(spark, sf)), "enriched")


@query(f"""WITH {SQL_TX} SELECT DISTINCT CAST(event_id * 3 AS VARCHAR) AS signature FROM events
WHERE CAST(event_id * 3 AS VARCHAR) NOT IN (SELECT signature FROM tx)""")
def enrich_missing(spark, sf):
    path = new_path(spark, "missing")
    records = fx.transactions(spark, sf)

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(ss.missing_notifications(batch, records), f"{path}/rows", batch_id)

    stream = notifications(spark, sf)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    return tables.read_batches(spark, f"{path}/rows", stream.schema).select("signature").distinct()


@query(f"""WITH {SQL_TX} SELECT tx.* FROM tx WHERE slot % 2 = 0 AND signature IN (SELECT CAST(event_id * 3 AS VARCHAR) FROM events)""")
def enrich_retry(spark, sf):
    """Records that come after their notification: missed at first, found by the second look."""
    notified = fx.table(spark, sf, "events").select((F.col("event_id") * 3).cast("string").alias("signature"))
    records = fx.transactions(spark, sf)
    missing = ss.missing_notifications(notified, records.where(F.col("slot") % 2 == 1))
    found, _ = ss.retry_missing(missing, records)
    return found


@query(f"""WITH {SQL_TX}, n AS (SELECT DISTINCT CAST(event_id * 3 AS VARCHAR) AS signature FROM events)
SELECT n.signature, CASE WHEN tx.signature IS NULL THEN 'waiting' ELSE 'found' END AS state, tx.fee FROM n LEFT JOIN tx USING (signature)""")
def enrich_late(spark, sf):
    """Records and notifications land in three parts: of two parts the notification comes before the record, of one after it."""
    landed, noted, path = new_path(spark, "landed"), new_path(spark, "noted"), new_path(spark, "followed")
    records = fx.transactions(spark, sf)
    notes = fx.table(spark, sf, "events").select((F.col("event_id") * 3).alias("n"), (F.col("event_id") * 3).cast("string").alias("signature"))
    for turn in range(3):
        records.where(F.col("slot") % 9 == 3 * turn).write.mode("append").parquet(landed)
        notes.where(F.col("n") % 9 == 3 * ((turn + 1) % 3)).write.mode("append").parquet(noted)
        streams = file_stream(spark, noted, notes.schema), file_stream(spark, landed, records.schema)
        pending.follow_notifications(*streams, lambda s: s.read.schema(records.schema).parquet(landed), path, "1 day").awaitTermination()
    found = pending.found_records(spark, path, records.schema).select("signature", F.lit("found").alias("state"), "fee")
    return found.unionByName(pending.waiting_notifications(spark, path).select(
        "signature", F.lit("waiting").alias("state"), F.lit(None).cast("bigint").alias("fee")))


@query("""SELECT CAST(user_id AS VARCHAR) AS pubkey, event_id AS slot, event_type AS owner FROM events
WHERE event_type IN ('click', 'view')""")
def scan_accounts(spark, sf):
    raw = fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("pubkey"),
                                               F.col("event_id").alias("slot"), F.col("event_type").alias("owner"))
    return ledger.scan_accounts(raw, ["click", "view"])


# ---- definitions and schemas ------------------------------------------------

SQL_GIVEN_DISC = " || ".join(f"lpad(lower(hex(CAST({i} * p_size % 256 AS BIGINT))), 2, '0')" for i in range(1, 9))
SQL_BRAND = "replace(p_brand, '#', '')"
SQL_INITCAP = "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"


def registry_sql(where: str = "TRUE") -> str:
    return f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS program_id, p_name AS program, *,
  {SQL_BRAND} AS brand, {SQL_INITCAP} AS kind FROM part WHERE {where})
SELECT program_id, program, 'instruction' AS item, 0 AS ordinal, brand || 'Set' AS name,
  substr(sha256('global:' || lower(brand) || '_set'), 1, 16) AS discriminator, '0,2' AS writable,
  '[{{"name":"slot","type":"u16"}}]' AS fields FROM p
UNION ALL SELECT program_id, program, 'instruction', 1, 'HTTPServer', {SQL_GIVEN_DISC}, '', '[]' FROM p
UNION ALL SELECT program_id, program, 'account', 0, kind, substr(sha256('account:' || kind), 1, 16), '',
  '[{{"name":"unitPrice","type":"u64"}}]' FROM p
UNION ALL SELECT program_id, program, 'type', 0, kind, '', '',
  '{{"kind":"struct","fields":[{{"name":"unitPrice","type":"u64"}}]}}' FROM p"""


def registry_rows(registry: df_.Registry) -> DataFrame:
    def rows(frame: DataFrame, item: str, discriminator: Column, writable: Column, fields: Column) -> DataFrame:
        return frame.select("program_id", "program", F.lit(item).alias("item"), "ordinal", "name",
                            discriminator.alias("discriminator"), writable.alias("writable"), fields.alias("fields"))
    empty = F.lit("")
    bytes_ = hexed(F.col("discriminator"))
    return (rows(registry.instructions, "instruction", bytes_, F.array_join("writable_positions", ","), F.col("fields"))
            .unionByName(rows(registry.accounts, "account", bytes_, empty, F.col("fields")))
            .unionByName(rows(registry.types, "type", empty, empty, F.col("type"))))


@query(registry_sql())
def registry(spark, sf):
    return registry_rows(df_.build_registry(fx.part_documents(spark, sf)))


@query(registry_sql("p_size >= 9"))
def registry_blobs(spark, sf):
    return registry_rows(df_.load_registry_blobs(fx.part_blobs(spark, sf)))


@query("""SELECT CASE WHEN p_size < 5 THEN 'too short' WHEN p_size < 9 THEN 'incomplete' ELSE 'ok' END AS status,
count(*) AS records FROM part GROUP BY 1""")
def registry_blob_report(spark, sf):
    found = df_.inflate_definitions(fx.part_blobs(spark, sf))
    return queries.ingest_report(found.select(F.coalesce("error", F.lit("ok")).alias("status")))


@query(f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS program_id, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS base,
  lower({SQL_BRAND}) AS brand, lower(p_type) AS kind FROM part),
c(t, ordinal, column_name, column_type) AS (VALUES
 ('sync_state', 0, 'program_id', 'string'), ('sync_state', 1, 'last_slot', 'bigint'),
 ('sync_state', 2, 'last_signature', 'string'), ('sync_state', 3, 'updated_at', 'timestamp'),
 ('transactions', 0, 'signature', 'string'), ('transactions', 1, 'slot', 'bigint'),
 ('transactions', 2, 'block_time', 'timestamp'), ('transactions', 3, 'success', 'boolean'),
 ('transactions', 4, 'fee', 'bigint'), ('transactions', 5, 'err_msg', 'string'),
 ('transactions', 6, 'indexed_at', 'timestamp'),
 ('instructions', 0, 'transaction_signature', 'string'), ('instructions', 1, 'slot', 'bigint'), ('instructions', 2, 'outer_index', 'int'),
 ('instructions', 3, 'inner_index', 'int'), ('instructions', 4, 'instruction_index', 'int'),
 ('instructions', 5, 'instruction_name', 'string'), ('instructions', 6, 'program_id', 'string'),
 ('instructions', 7, 'args', 'variant'), ('instructions', 8, 'accounts', 'array<string>'),
 ('instructions', 9, 'raw_data', 'binary'), ('instructions', 10, 'decode_status', 'string'),
 ('instructions', 11, 'indexed_at', 'timestamp'),
 ('A', 0, 'transaction_signature', 'string'), ('A', 1, 'outer_index', 'int'), ('A', 2, 'inner_index', 'int'),
 ('A', 3, 'instruction_index', 'int'), ('A', 4, 'slot', 'int'), ('A', 5, 'indexed_at', 'timestamp'),
 ('B', 0, 'transaction_signature', 'string'), ('B', 1, 'outer_index', 'int'), ('B', 2, 'inner_index', 'int'),
 ('B', 3, 'instruction_index', 'int'), ('B', 4, 'indexed_at', 'timestamp'),
 ('C', 0, 'pubkey', 'binary'), ('C', 1, 'slot', 'bigint'), ('C', 2, 'transaction_signature', 'string'),
 ('C', 3, 'data', 'variant'), ('C', 4, 'unitprice', 'decimal(20,0)'), ('C', 5, 'source', 'string'),
 ('C', 6, 'observed_at', 'timestamp'), ('C', 7, 'indexed_at', 'timestamp'))
SELECT program_id, CASE t WHEN 'A' THEN base || '_ix_' || brand || 'set' WHEN 'B' THEN base || '_ix_httpserver'
  WHEN 'C' THEN base || '_' || kind ELSE t END AS table_name, CAST(ordinal AS INTEGER) AS ordinal, column_name, column_type
FROM p, c""")
def schemas(spark, sf):
    return schema_table(fx.part_documents(spark, sf))


TYPE_NAMES = {
    "bool": "boolean", "u8": "smallint", "i8": "tinyint", "u16": "int", "i16": "smallint", "u32": "bigint",
    "i32": "int", "u64": "decimal(20,0)", "i64": "bigint", "u128": "string", "i128": "string", "f32": "float",
    "f64": "double", "string": "string", "pubkey": "binary", "publicKey": "binary", "bytes": "binary",
    '{"option":"u16"}': "int", '{"vec":"u64"}': "array<decimal(20,0)>",
    '{"array":["u8",32]}': "array<smallint>", '{"vec":{"option":{"vec":"bool"}}}': "array<array<boolean>>",
    '{"defined":{"name":"Gone"}}': "variant", "u256": "variant"}
_TYPES = list(TYPE_NAMES)


@query("SELECT CASE p_size % {n} {cases} END AS idl_type, CASE p_size % {n} {types} END AS spark_type, count(*) AS parts "
       "FROM part GROUP BY 1, 2".format(
           n=len(_TYPES), cases=" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)),
           types=" ".join(f"WHEN {i} THEN '{TYPE_NAMES[t]}'" for i, t in enumerate(_TYPES))))
def type_map(spark, sf):
    described = F.get(F.array(*[F.lit(t) for t in _TYPES]), F.col("p_size") % len(_TYPES))
    counted = fx.table(spark, sf, "part").groupBy(described.alias("idl_type")).agg(F.count("*").alias("parts"))
    return counted.select("idl_type", type_name(F.col("idl_type")).alias("spark_type"), "parts")


@query("""SELECT p_partkey, regexp_replace(translate('My-Åcc ' || p_brand || p_type || ' ß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[^\\pL\\pN_]', '_', 'g') AS sanitized FROM part""")
def sanitize(spark, sf):
    raw = F.concat(F.lit("My-Åcc "), "p_brand", "p_type", F.lit(" ß"))
    return fx.table(spark, sf, "part").select("p_partkey", names.sanitize(raw).alias("sanitized"))


SQL_CAMEL = "p_name || p_brand || 'HTTPServer'"
SQL_SNAKE = f"lower(regexp_replace({SQL_CAMEL}, '([A-Z])', '_\\1', 'g'))"


def camel() -> Column:
    return F.concat("p_name", "p_brand", F.lit("HTTPServer"))


@query(f"SELECT p_partkey, {SQL_SNAKE} AS snake FROM part")
def snake_case(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", names.snake_case(camel()).alias("snake"))


@query(f"SELECT p_partkey, substr(sha256('global:' || {SQL_SNAKE}), 1, 16) AS disc FROM part")
def disc_ix(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", hexed(names.instruction_discriminator(camel())).alias("disc"))


@query(f"SELECT p_partkey, substr(sha256('account:' || {SQL_CAMEL}), 1, 16) AS disc FROM part")
def disc_account(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", hexed(names.account_discriminator(camel())).alias("disc"))


# ---- decode -----------------------------------------------------------------

@query("""SELECT CAST(l_suppkey AS VARCHAR) AS program_id,
CASE WHEN l_linenumber = 7 OR l_returnflag || l_linestatus = 'NO' THEN 'unknown'
  ELSE 'fill_' || lower(l_returnflag || l_linestatus) END AS name,
NOT (l_linenumber = 7 OR l_returnflag || l_linestatus = 'NO') AS matched, count(*) AS records
FROM lineitem GROUP BY 1, 2, 3""")
def dispatch_ix(spark, sf):
    definitions = df_.build_registry(fx.supplier_documents(spark, sf)).instructions
    rows = dispatch(fx.shop_payloads(spark, sf), definitions)
    return rows.groupBy("program_id", "name", "matched").agg(F.count("*").alias("records"))


def wallets() -> Interface:
    return parse_interface(fx.wallet_document())


def wallet_states(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    raw = fx.raw_accounts_of(fx.table(spark, sf, "events") if events is None else events)
    return dispatch(raw.withColumnRenamed("owner", "program_id"), [wallets()], "account")


@query("""SELECT CASE event_type WHEN 'error' THEN 'unknown' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END
AS name, CAST(user_id AS VARCHAR) AS pubkey, count(*) AS records FROM events GROUP BY 1, 2""")
def dispatch_account(spark, sf):
    return wallet_states(spark, sf).groupBy("name", "pubkey").agg(F.count("*").alias("records"))


@query("""SELECT l_orderkey AS "order", l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, 'ok' AS decode_status,
0 AS trailing_bytes FROM lineitem""")
def decode_fixed(spark, sf):
    rows = decoded_one(fx.fill_payloads(spark, sf), fx.FILL)
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("order", "part", "supplier")],
                       F.col("line").cast("int").alias("line"), "quantity", "price", "discount", "tax",
                       "decode_status", "trailing_bytes")


SQL_CUT = """cut AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 5 * l_linenumber AS n FROM lineitem),
cut_read AS (SELECT CASE WHEN n >= 8 THEN l_orderkey END AS "order",
  CASE WHEN n >= 9 THEN l_linenumber END AS line, CASE WHEN n >= 13 THEN l_partkey END AS part,
  CASE WHEN n >= 21 THEN l_suppkey END AS supplier,
  CASE WHEN n >= 21 THEN 'ok' ELSE 'partial' END AS decode_status,
  CASE WHEN n < 8 THEN 'order' WHEN n < 9 THEN 'line' WHEN n < 13 THEN 'part' WHEN n < 21 THEN 'supplier' END AS failed_field,
  CASE WHEN n < 8 THEN 8 WHEN n < 9 THEN 16 WHEN n < 13 THEN 17 WHEN n < 21 THEN 21 END AS failed_offset,
  CASE WHEN n >= 21 THEN n - 21 END AS trailing_bytes FROM cut)"""


def cut_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = decoded_one(fx.cut_payloads(spark, sf), fx.CUT)
    return rows.select(F.col("order").cast("bigint").alias("order"), F.col("line").cast("int").alias("line"),
                       "part", "supplier", "decode_status", "failed_field", "failed_offset", "trailing_bytes")


CUT_COLUMNS = ["order", "line", "part", "supplier", "failed_offset", "trailing_bytes"]
SQL_CUT_COLUMNS = ", ".join(f'coalesce("{c}", -1) AS "{c}"' for c in CUT_COLUMNS) + ", decode_status, failed_field"


def cut_columns(df: DataFrame) -> DataFrame:
    return df.select(*[minus(c) for c in CUT_COLUMNS], "decode_status", "failed_field")


@query(f"WITH {SQL_CUT} SELECT {SQL_CUT_COLUMNS} FROM cut_read")
def decode_partial(spark, sf):
    return cut_columns(cut_read(spark, sf))


@query(f"WITH {SQL_CUT} SELECT {SQL_CUT_COLUMNS} FROM cut_read WHERE decode_status <> 'ok'")
def quarantine(spark, sf):
    return cut_columns(dc.quarantine(cut_read(spark, sf)))


@query("""SELECT d.doc_id AS doc, coalesce(l.quality, -1) AS quality, coalesce(-l.toxic, 9) AS toxic, 42 AS "end", 'ok' AS decode_status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def decode_option(spark, sf):
    rows = decoded_one(fx.option_payloads(spark, sf), fx.OPTIONS)
    return rows.select(F.col("doc").cast("bigint").alias("doc"), F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("quality"),
                       F.coalesce("toxic", F.lit(9)).alias("toxic"), F.col("end").cast("int").alias("end"), "decode_status")


SQL_VECTORS = """SELECT vec_id AS id, label, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS item,
'ok' AS decode_status FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"""


def vector_items(rows: DataFrame) -> DataFrame:
    return (rows.select(F.col("id").cast("bigint").alias("id"), "label", "decode_status",
                        F.posexplode("items").alias("pos", "item"))
            .withColumn("item", F.col("item").cast("double")))


@query(SQL_VECTORS)
def decode_vec(spark, sf):
    return vector_items(decoded_one(fx.vector_payloads(spark, sf, counted=True), fx.VECTORS))


@query(SQL_VECTORS)
def decode_array(spark, sf):
    return vector_items(decoded_one(fx.vector_payloads(spark, sf, counted=False), fx.ARRAYS))


@query("""SELECT conv_id AS conv, CASE WHEN role <> 'system' THEN role END AS role,
CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 9 END AS role_index,
CASE WHEN role = 'system' THEN 'Plain' ELSE 'Said' END AS body, CASE WHEN role <> 'system' THEN turn ELSE -1 END AS turn,
CASE WHEN role <> 'system' THEN "text" END AS "text",
CASE WHEN role = 'system' THEN '{"variant":9}' ELSE '"' || role || '"' END AS role_json,
CASE WHEN role = 'system' THEN '"Plain"' END AS body_json FROM conversations""")
def decode_enum(spark, sf):
    rows = decoded_one(fx.turn_payloads(spark, sf), fx.TURNS, json_column="json")
    shown = F.parse_json("json")
    plain = F.when(F.col("body.variant") == "Plain", F.to_json(F.variant_get(shown, "$.body", "variant")))
    return rows.select(
        F.col("conv").cast("bigint").alias("conv"), F.col("role.variant").alias("role"),
        F.col("role.idx").cast("int").alias("role_index"), F.col("body.variant").alias("body"),
        F.coalesce("body.Said.turn", F.lit(-1)).alias("turn"), F.col("body.Said.text").alias("text"),
        F.to_json(F.variant_get(shown, "$.role", "variant")).alias("role_json"), plain.alias("body_json"))


@query("""SELECT l_linestatus = 'O' AS "open", l_linenumber + 200 AS a, -l_linenumber AS b,
CAST(l_partkey % 65536 AS INTEGER) AS c, CAST(-(l_partkey % 32768) AS INTEGER) AS d, l_partkey + 3000000000 AS e,
CAST(-l_partkey AS INTEGER) AS f, CAST(9223372036854775808::HUGEINT + l_orderkey AS VARCHAR) AS g, -l_orderkey AS h
FROM lineitem""")
def decode_primitives(spark, sf):
    rows = decoded_one(fx.number_payloads(spark, sf), fx.NUMBERS)
    return rows.select("open", *[F.col(c).cast("int").alias(c) for c in "abcdf"], "e",
                       F.col("g").cast("string").alias("g"), "h")


def sql_word(digest: str, at: int) -> str:
    pairs = " || ".join(f"substr({digest}, {at + 14 - 2 * i}, 2)" for i in range(8))
    return f"CAST(CAST('0x' || {pairs} AS UBIGINT) AS UHUGEINT)"


@query(f"""WITH d AS (SELECT o_orderkey, {sql_word("md5(CAST(o_orderkey AS VARCHAR))", 1)} AS lo,
  {sql_word("md5(CAST(o_orderkey AS VARCHAR))", 17)} AS hi FROM orders)
SELECT o_orderkey AS "order", CAST(hi * 18446744073709551616::UHUGEINT + lo AS VARCHAR) AS u,
CASE WHEN hi < 9223372036854775808::UHUGEINT THEN CAST(hi * 18446744073709551616::UHUGEINT + lo AS VARCHAR)
  ELSE '-' || CAST((18446744073709551615::UHUGEINT - hi) * 18446744073709551616::UHUGEINT
    + (18446744073709551615::UHUGEINT - lo) + 1::UHUGEINT AS VARCHAR) END AS i FROM d""")
def decode_u128(spark, sf):
    rows = decoded_one(fx.wide_payloads(spark, sf), fx.WIDE)
    return rows.select(F.col("order").cast("bigint").alias("order"), "u", "i")


@query("""SELECT l_extendedprice AS price, -l_extendedprice * l_discount AS negative,
CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS small, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS rate FROM lineitem""")
def decode_float(spark, sf):
    rows = decoded_one(fx.float_payloads(spark, sf), fx.FLOATS)
    return rows.select("price", "negative", *[F.col(c).cast("double").alias(c) for c in ("small", "rate")])


@query("""SELECT doc_id AS doc, "text", CASE WHEN lang <> 'en' THEN lang END AS lang, source AS raw, -n_chars AS n,
'ok' AS decode_status FROM documents""")
def decode_string(spark, sf):
    rows = decoded_one(fx.text_payloads(spark, sf), fx.TEXTS)
    return rows.select(F.col("doc").cast("bigint").alias("doc"), "text", "lang",
                       F.col("raw").cast("string").alias("raw"), "n", "decode_status")


@query(f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, coalesce(inner_index, -1) AS inner_index,
instruction_index, o_orderkey AS "order", o_custkey AS customer FROM flat WHERE name = 'placeOrder'""")
def typed_ix(spark, sf):
    rows = dc.typed_instructions(dispatched(spark, sf), desk(), "placeOrder")
    return rows.select("transaction_signature", "outer_index", minus("inner_index"), "instruction_index",
                       *[F.col(c).cast("bigint").alias(c) for c in ("order", "customer")])


@query("""SELECT CAST(user_id AS VARCHAR) AS pubkey, event_id AS slot, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 50 THEN 'Purchase' END AS label,
CAST(json_extract(props, '$.k') AS BIGINT) AS json_k, 'ok' AS decode_status FROM events WHERE event_type = 'purchase'""")
def typed_accounts(spark, sf):
    rows = dc.typed_accounts(wallet_states(spark, sf), wallets(), "Purchase", keep=["pubkey", "slot"])
    return rows.select("pubkey", "slot", "k", "value", "label",
                       F.get_json_object("data_json", "$.k").cast("bigint").alias("json_k"), "decode_status")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS kval, CAST(NULL AS VARCHAR) AS missing FROM events""")
def populate(spark, sf):
    schema = T.StructType([T.StructField("kval", T.LongType()), T.StructField("missing", T.StringType())])
    text = F.replace(F.col("props"), F.lit('"k"'), F.lit('"kVal"'))
    record = dc.populate(text, schema, ["kVal"])
    return fx.table(spark, sf, "events").select("event_id", record.alias("r")).select("event_id", "r.*")


def desk_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the desk program, decoded to JSON arguments in one pass."""
    return dc.decode_ledger(fx.raw_transactions(spark, sf), [desk()])


@query(f"""WITH {SQL_FLAT} SELECT name, CASE WHEN name = 'unknown' THEN 'unknown' ELSE 'ok' END AS decode_status,
count(*) AS records FROM flat WHERE program = '{DESK_HEX}' GROUP BY 1, 2""")
def decode_report(spark, sf):
    return dc.decode_report(desk_ledger(spark, sf), by=("name",))


SQL_DECODED = f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, coalesce(inner_index, -1) AS inner_index, name,
CASE name WHEN 'placeOrder' THEN '{{"order":' || o_orderkey || ',"customer":' || o_custkey || '}}'
  WHEN 'note' THEN '{{"text":"' || o_orderpriority || '","order":' || o_orderkey || '}}' END AS args
FROM flat WHERE program = '{DESK_HEX}'"""


@query(SQL_DECODED)
def decode_all(spark, sf):
    return desk_ledger(spark, sf).select("transaction_signature", "outer_index", minus("inner_index"), "name", "args")


@query(f"""WITH p AS (SELECT *, p_partkey % {fx.MILL_LAYOUTS} AS i, CASE p_size % 2 WHEN 1 THEN 'true' ELSE 'false' END AS odd FROM part),
t AS (SELECT *, 'first' || i AS a, ',"second' || i || '":' AS b, '{{"wide' || i || '":' || p_partkey || ',"flag' || i || '":' || odd || '}}' AS box FROM p)
SELECT p_partkey, 'step' || i AS name, 'ok' AS decode_status, CASE i % 12 WHEN 0 THEN '{{}}' ELSE '{{"' || a || '":' || CASE i % 12
  WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN '"' || p_name || '"' || b || p_partkey WHEN 3 THEN p_partkey || b || '"' || p_brand || '"'
  WHEN 4 THEN odd || b || p_size WHEN 5 THEN CASE odd WHEN 'true' THEN CAST(p_partkey AS VARCHAR) ELSE 'null' END
  WHEN 6 THEN '[' || p_size || ',' || (p_size + 1) || ']' || b || -p_size WHEN 7 THEN box
  WHEN 8 THEN CASE odd WHEN 'true' THEN '{{"On' || i || '":{{"by' || i || '":' || p_size || '}}}}' ELSE '"Off' || i || '"' END || b || p_size
  WHEN 9 THEN -p_partkey || b || p_size WHEN 10 THEN '[' || p_partkey || ',' || p_size || ']' ELSE '[' || box || ',' || box || ']' END || '}}' END AS args FROM t""")
def decode_shapes(spark, sf):
    """A program with over a hundred instructions of twelve shapes, decoded in one pass."""
    face = parse_interface(fx.mill_document())
    rows = dc.decode_all(dispatch(fx.mill_payloads(spark, sf), [face]), face)
    return rows.select("p_partkey", "name", "decode_status", "args")


@query(f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index,
coalesce(inner_index, -1) AS inner_index, name AS instruction_name, program, data AS raw_data,
len(string_split(accounts, ',')) AS n_accounts, CASE WHEN name = 'unknown' THEN 'unknown' ELSE 'ok' END AS decode_status,
CASE name WHEN 'placeOrder' THEN CAST(o_custkey AS VARCHAR) WHEN 'note' THEN o_orderpriority WHEN 'unknown' THEN 'null'
  ELSE 'amount' END AS shown FROM flat WHERE program IS NOT NULL""")
def instructions_table(spark, sf):
    """The published instructions table of two programs, straight from raw transactions."""
    faces = [desk(), parse_interface(fx.prices_document())]
    rows = dc.publish_instructions(dc.decode_ledger(fx.raw_transactions(spark, sf), faces), json_null=True)
    shown = F.coalesce(F.try_variant_get("args", "$.customer", "string"), F.try_variant_get("args", "$.text", "string"),
                       F.when(F.is_variant_null("args"), "null").otherwise("amount"))
    return rows.select("transaction_signature", "outer_index", minus("inner_index"), "instruction_name",
                       hexed(unbase58(F.col("program_id"))).alias("program"), hexed(F.col("raw_data")).alias("raw_data"),
                       F.size("accounts").cast("bigint").alias("n_accounts"), "decode_status", shown.alias("shown"))


@query("""SELECT doc_id AS id, CAST(len(string_split("text", chr(10))) AS INTEGER) AS n_lines, "text" FROM documents""")
def decode_nested_lists(spark, sf):
    """Lists of varying-size items: the layouts that are read by the row walker."""
    face = fx.one_layout("pages", [{"name": "id", "type": "u64"}, {"name": "lines", "type": {"vec": "string"}}])
    lines = F.split("text", "\n")
    body = F.unhex(F.array_join(F.transform(lines, lambda t: F.hex(fx.text_bytes(t))), ""))
    payloads = fx.table(spark, sf, "documents").select(
        F.concat(fx.disc("pages"), fx.le(F.col("doc_id"), 8), fx.le(F.size(lines), 4), body).alias("data"))
    rows = decoded_one(payloads, face)
    return rows.select(F.col("id").cast("bigint").alias("id"), F.size("lines").alias("n_lines"),
                       F.array_join("lines", "\n").alias("text"))


# ---- transactions and instructions ------------------------------------------

@query(f"WITH {SQL_TX} SELECT * FROM tx")
def to_transactions(spark, sf):
    rows = fl.to_transactions(fx.raw_transactions(spark, sf))
    return rows.withColumn("block_time", ntz(F.col("block_time"))).drop("indexed_at")


SQL_STATUS = "CASE WHEN o_orderpriority <> '1-URGENT' THEN 'ok' WHEN o_orderkey % 2 = 1 THEN 'bad_base64' ELSE 'bad_message' END"


@query(f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, program, accounts, data
FROM flat WHERE inner_index IS NULL AND o_orderpriority <> '1-URGENT'""")
def unpack(spark, sf):
    rows = fl.flatten_instructions(unpack_messages(fx.wire_transactions(spark, sf)))
    return rows.select("transaction_signature", "outer_index", hexed(F.col("program_id")).alias("program"),
                       key_text(F.col("accounts")).alias("accounts"), hexed(F.col("data")).alias("data"))


@query(f"SELECT {SQL_STATUS} AS status, count(*) AS records FROM orders GROUP BY 1")
def unpack_report(spark, sf):
    rows = unpack_messages(fx.wire_transactions(spark, sf))
    return queries.ingest_report(rows.withColumnRenamed("unpack_status", "status"))


def flat_columns(df: DataFrame) -> DataFrame:
    return df.select("transaction_signature", "slot", "outer_index", minus("inner_index"), "instruction_index",
                     hexed(F.col("program_id")).alias("program"), hexed(F.col("data")).alias("data"))


SQL_FLAT_COLUMNS = """CAST(o_orderkey AS VARCHAR) AS transaction_signature, o_orderkey AS slot, outer_index, coalesce(inner_index, -1) AS inner_index,
instruction_index, program, data"""


@query(f"WITH {SQL_FLAT} SELECT {SQL_FLAT_COLUMNS} FROM flat WHERE inner_index IS NULL")
def flatten_outer(spark, sf):
    return flat_columns(flat(spark, sf).where(F.col("inner_index").isNull()))


@query(f"WITH {SQL_FLAT} SELECT {SQL_FLAT_COLUMNS} FROM flat WHERE inner_index IS NOT NULL")
def flatten_inner(spark, sf):
    return flat_columns(flat(spark, sf).where(F.col("inner_index").isNotNull()))


@query(f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, coalesce(inner_index, -1) AS inner_index, accounts,
replace(accounts, ',-', '') AS compact FROM flat""")
def resolve_accounts(spark, sf):
    """Accounts with and without the missing ones, side by side in the row of the transaction."""
    raw = fx.raw_transactions(spark, sf)
    pairs = F.zip_with(fl.instruction_array(raw), fl.instruction_array(raw, compact=True),
                       lambda whole, short: F.struct(whole.alias("whole"), short["accounts"].alias("compact")))
    both = raw.select(F.col("signature").alias("transaction_signature"), F.explode(pairs).alias("p")).select(
        "transaction_signature", "p.whole.*", "p.compact")
    return both.select("transaction_signature", "outer_index", minus("inner_index"), key_text(F.col("accounts")).alias("accounts"), key_text(F.col("compact")).alias("compact"))


@query(f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, coalesce(inner_index, -1) AS inner_index
FROM flat WHERE program = '{PRICES_HEX}'""")
def for_programs(spark, sf):
    return ledger.for_programs(flat(spark, sf), [fx.PRICES]).select("transaction_signature", "outer_index", minus("inner_index"))


@query(f"""WITH {SQL_FLAT}, hit AS (
  SELECT o_orderkey, outer_index, inner_index, {SQL_KEY_C} AS pubkey FROM flat WHERE name IN ('placeOrder', 'note')
  UNION ALL SELECT o_orderkey, outer_index, inner_index, {SQL_KEY_O} FROM flat WHERE name = 'placeOrder'
  UNION ALL SELECT o_orderkey, outer_index, inner_index, accounts FROM flat WHERE name = 'price')
SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, coalesce(inner_index, -1) AS inner_index, pubkey FROM hit""")
def touched(spark, sf):
    rows = fl.touched_accounts(dispatched(spark, sf))
    return rows.select("transaction_signature", "outer_index", minus("inner_index"), hexed(F.col("pubkey")).alias("pubkey"))


# ---- listings ---------------------------------------------------------------

@query(f"""WITH {SQL_TX} SELECT * FROM tx WHERE slot >= 100 AND slot <= 4000000000 AND success
ORDER BY slot DESC, signature DESC LIMIT 200 OFFSET 50""")
def list_transactions(spark, sf):
    rows = queries.filter_transactions(fx.transactions(spark, sf), slot_from=100, slot_to=4000000000, success=True)
    return queries.page(rows, queries.TRANSACTION_ORDER, limit=200, offset=50).data


@query(f"""WITH {SQL_IX} SELECT transaction_signature, slot, outer_index, instruction_name, program_id, part, price, indexed_at
FROM ix WHERE instruction_name = 'R_F' AND program_id = '7'
ORDER BY slot DESC, transaction_signature DESC, outer_index DESC, part DESC, price DESC, indexed_at DESC LIMIT 50""")
def list_instructions(spark, sf):
    rows = queries.filter_instructions(fx.instructions(spark, sf), name="R_F", program_id="7")
    order = ("slot", "transaction_signature", "outer_index", "part", "price", "indexed_at")
    return queries.page(rows, order).data.drop("inner_index", "instruction_index")


@query("""SELECT CAST(user_id AS VARCHAR) AS pubkey, event_id AS slot, ts AS observed_at, props AS data FROM events
WHERE event_type = 'purchase' AND user_id = 8 AND event_id >= 3 ORDER BY event_id DESC LIMIT 9999""")
def list_accounts(spark, sf):
    states = fx.account_states(spark, sf)
    by_type = {t: states.where(F.col("account_type") == t) for t in ("purchase", "view")}
    rows = queries.filter_accounts(by_type, "purchase", pubkey="8", slot_from=3)
    return queries.page(rows, queries.ACCOUNT_ORDER, limit=9999).data.select("pubkey", "slot", "observed_at", "data")


@query("""SELECT CAST(user_id AS VARCHAR) AS account, event_id AS slot, props AS data FROM events
WHERE event_type = 'view' AND user_id = 8""")
def list_accounts_key(spark, sf):
    """Keys stored as bytes, found by their base58 text."""
    states = fx.account_states(spark, sf).where(F.col("account_type") == "view")
    states = states.withColumn("account", F.col("pubkey")).withColumn("pubkey", fx.key32(F.col("pubkey")))
    rows = queries.filter_accounts({"view": states}, "view", pubkey=encode_values([fx.key32_of("8")])[0])
    return rows.select("account", "slot", "data")


@query(f"""WITH {SQL_TX} SELECT * FROM tx WHERE success ORDER BY slot DESC, signature DESC LIMIT 700 OFFSET 5""")
def page_large(spark, sf):
    rows = queries.filter_transactions(fx.transactions(spark, sf), success=True)
    return queries.page(rows, queries.TRANSACTION_ORDER, limit=700, offset=5).data


@query(f"""WITH {SQL_IX} SELECT count(*) AS total FROM ix WHERE instruction_name = 'A_F'""")
def page_total(spark, sf):
    rows = queries.filter_instructions(fx.instructions(spark, sf), name="A_F")
    return queries.page(rows, queries.INSTRUCTION_ORDER).envelope.select("total")


@query(f"""WITH {SQL_TX} SELECT count(*) AS total, CAST(700 AS BIGINT) AS "limit", CAST(1200 AS BIGINT) AS "offset",
1900 < count(*) AS has_next FROM tx WHERE success""")
def page_envelope(spark, sf):
    rows = queries.filter_transactions(fx.transactions(spark, sf), success=True)
    return queries.page(rows, queries.TRANSACTION_ORDER, limit=700, offset=1200).envelope


# ---- joins and states -------------------------------------------------------

CUTOVER = "1998-01-01"


def stored_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Instructions up to a day are stored already; the batch brings the whole table again."""
    rows = fx.instructions(spark, sf)
    return rows.where(F.col("indexed_at") < F.lit(CUTOVER).cast("timestamp_ntz")), rows


SQL_NEW = f"""stored AS (SELECT DISTINCT transaction_signature, outer_index FROM ix WHERE indexed_at < TIMESTAMP '{CUTOVER}'),
fresh AS (SELECT ix.* FROM ix LEFT JOIN stored s USING (transaction_signature, outer_index)
  WHERE s.outer_index IS NULL)"""
IX_KEY = ["transaction_signature", "outer_index"]
IX_COLUMNS = ["transaction_signature", "slot", "outer_index", "instruction_name", "program_id", "part", "price", "indexed_at"]


@query(f"""WITH {SQL_IX}, {SQL_NEW} SELECT {', '.join(IX_COLUMNS)} FROM fresh""")
def new_only(spark, sf):
    stored, batch = stored_and_batch(spark, sf)
    return tables.new_only(batch, stored, IX_KEY).select(*IX_COLUMNS)


@query(f"""WITH {SQL_IX}, {SQL_NEW} SELECT {', '.join(IX_COLUMNS)} FROM (SELECT *, row_number() OVER (
  PARTITION BY transaction_signature, outer_index ORDER BY indexed_at, part, price, program_id, instruction_name) AS n
  FROM ix) WHERE n = 1 AND (transaction_signature, outer_index) NOT IN (SELECT (transaction_signature, outer_index) FROM stored)""")
def insert_if_absent(spark, sf):
    stored, batch = stored_and_batch(spark, sf)
    bucketed = [df.withColumn("slot_bucket", tables.slot_bucket(F.col("slot"))) for df in (batch, stored)]
    order = ["indexed_at", "part", "price", "program_id", "instruction_name"]
    return tables.insert_if_absent(*bucketed, IX_KEY, order, prune="slot_bucket").select(*IX_COLUMNS)


def touches(spark: SparkSession, sf: str) -> DataFrame:
    """Every order touches its customer's account at its slot."""
    return fx.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("pubkey"),
                                                F.col("o_orderkey").alias("slot"))


def user_states(spark: SparkSession, sf: str) -> DataFrame:
    return fx.account_states(spark, sf).select("pubkey", "slot", "data", "value")


@query("""WITH s AS (SELECT user_id, max(event_id) AS state_slot, arg_max(props, event_id) AS data,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id)
SELECT CAST(o_custkey AS VARCHAR) AS pubkey, o_orderkey AS slot, state_slot, data, value
FROM orders JOIN s ON o_custkey = user_id""")
def state_latest(spark, sf):
    return lookups.account_state_at(touches(spark, sf), user_states(spark, sf), mode="latest")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS pubkey, o_orderkey AS slot, event_id AS state_slot, props AS data, value
FROM orders ASOF JOIN events ON o_custkey = user_id AND o_orderkey >= event_id""")
def state_asof(spark, sf):
    rows = lookups.account_state_at(touches(spark, sf), user_states(spark, sf), mode="asof")
    return rows.select("pubkey", "slot", "state_slot", "data", "value")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS transaction_signature, l_linenumber AS outer_index,
l_extendedprice AS price, o_orderkey AS tx_slot, o_orderdate AS block_time, o_orderstatus <> 'F' AS success
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey BETWEEN 100 AND 4000000000""")
def ix_with_tx(spark, sf):
    rows = lookups.with_transaction(fx.instructions(spark, sf), fx.transactions(spark, sf), 100, 4000000000)
    return rows.select("transaction_signature", "outer_index", "price", F.col("slot").alias("tx_slot"),
                       "block_time", "success")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS transaction_signature, l_linenumber AS outer_index, l_partkey AS part
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def orphans(spark, sf):
    known = queries.filter_transactions(fx.transactions(spark, sf), success=True)
    return lookups.orphans(fx.instructions(spark, sf), known).select("transaction_signature", "outer_index", "part")


# ---- aggregates -------------------------------------------------------------

@query(f"""WITH {SQL_TX} SELECT count(*) AS total_transactions, count(*) FILTER (success) AS successful_transactions,
count(*) FILTER (NOT success) AS failed_transactions, (SELECT count(*) FROM lineitem) AS total_instructions,
max(slot) AS latest_slot FROM tx""")
def stats(spark, sf):
    return queries.stats(fx.transactions(spark, sf), fx.instructions(spark, sf))


@query(f"WITH {SQL_IX} SELECT instruction_name AS name, count(*) AS count FROM ix GROUP BY 1")
def breakdown(spark, sf):
    return queries.instruction_breakdown(fx.instructions(spark, sf))


def bucket_sql(period: str, where: str = "TRUE", shown: str = "period", newest: str = "") -> str:
    return f"""WITH {SQL_IX}, b AS (SELECT CAST(date_trunc('{period}', indexed_at) AS TIMESTAMP) AS period, instruction_name,
  count(*) AS count FROM ix WHERE {where} GROUP BY 1, 2 {newest})
SELECT {shown} AS period, instruction_name, count FROM b"""


@query(bucket_sql("hour"))
def buckets_hour(spark, sf):
    return queries.instruction_buckets(fx.instructions(spark, sf), "hour").withColumn("period", ntz(F.col("period")))


@query(bucket_sql("day"))
def buckets_day(spark, sf):
    return queries.instruction_buckets(fx.instructions(spark, sf), "day").withColumn("period", ntz(F.col("period")))


@query(bucket_sql("day", "instruction_name = 'R_F' AND indexed_at >= TIMESTAMP '1996-02-03' AND indexed_at <= TIMESTAMP '1998-05-06'"))
def buckets_range(spark, sf):
    rows = queries.instruction_buckets(fx.instructions(spark, sf), "day", name="R_F", from_time="1996-02-03 00:00:00",
                                       to_time="1998-05-06 00:00:00")
    return rows.withColumn("period", ntz(F.col("period")))


@query(bucket_sql("hour", newest="ORDER BY period DESC, instruction_name LIMIT 1000"))
def buckets_top(spark, sf):
    """The newest thousand buckets, as a caller may ask for."""
    rows = queries.instruction_buckets(fx.instructions(spark, sf), "hour", limit=queries.SERVICE_BUCKETS)
    return rows.withColumn("period", ntz(F.col("period")))


@query(bucket_sql("hour", shown="strftime(period, '%Y-%m-%dT%H:%M:%S') || '+00:00'"))
def buckets_rfc3339(spark, sf):
    rows = queries.instruction_buckets(fx.instructions(spark, sf), "anything")
    return rows.withColumn("period", rfc3339(F.col("period")))


@query(f"""WITH {SQL_TX}, m(name, help, value) AS (
  SELECT 'indexer_transactions_total', 'Total indexed transactions', count(*) FROM tx
  UNION ALL SELECT 'indexer_instructions_total', 'Total indexed instructions', count(*) FROM lineitem
  UNION ALL SELECT 'indexer_latest_slot', 'Latest indexed slot', coalesce(max(slot), 0) FROM tx)
SELECT name, help, 'gauge' AS type, CAST(value AS BIGINT) AS value, '# HELP ' || name || ' ' || help || chr(10) || '# TYPE ' || name || ' gauge'
  || chr(10) || name || ' ' || value || chr(10) AS rendered FROM m""")
def metrics(spark, sf):
    return queries.metrics(fx.transactions(spark, sf), fx.instructions(spark, sf))


@query("""SELECT 'wallets' AS program, event_type AS account_type, CAST(user_id AS VARCHAR) AS pubkey, max(event_id) AS slot,
max(ts) AS observed_at, arg_max(props, ts) AS data, arg_max(value, ts) AS value FROM events GROUP BY event_type, user_id""")
def latest_accounts(spark, sf):
    return lookups.latest_accounts(fx.account_states(spark, sf))


@query(f"""SELECT {SQL_STATUS} AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'processed' WHEN '2-HIGH' THEN 'finalized'
ELSE 'confirmed' END AS commitment, count(*) AS records FROM orders GROUP BY 1, 2""")
def ingest_report(spark, sf):
    rows = unpack_messages(fx.wire_transactions(spark, sf)).withColumnRenamed("unpack_status", "status")
    return queries.ingest_report(rows, by=("commitment",))


@query(f"""SELECT {SQL_STATUS} AS status, count(*) AS records FROM orders GROUP BY 1""")
def ingest_counts(spark, sf):
    """The same from a stream, counted while its batches run."""
    path = new_path(spark, "counted")
    raw = order_files(spark, sf, (0, 1, 2), fx.wire_transactions_of)
    rows = counts.observed(unpack_messages(raw), "ingest", F.col("unpack_status"))
    writer = counts.CountWriter(spark, "ingest", f"{path}/counts")
    spark.streams.addListener(writer)
    try:
        query = rows.writeStream.format("noop").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        writer.wait(query)
    finally:
        spark.streams.removeListener(writer)
    return counts.read_counts(spark, f"{path}/counts").groupBy("status").agg(F.sum("records").alias("records"))


# ---- tables -----------------------------------------------------------------

@query(f"""WITH {SQL_TX} SELECT * REPLACE (fee - CASE WHEN success AND slot % 2 = 0 THEN 1 ELSE 0 END AS fee) FROM tx""")
def bridge(spark, sf):
    """Live records come again in history, half of them with a smaller fee, which settles the tie."""
    tx = fx.transactions(spark, sf)
    live = tx.where(F.col("success")).withColumn("fee", F.col("fee") - (F.col("slot") % 2 == 0).cast("int"))
    return tables.bridge(tx, live)


@query("""SELECT CAST(user_id AS VARCHAR) AS program_id, max(event_id) AS last_slot, arg_max(event_type, event_id) AS last_signature
FROM events GROUP BY 1""")
def upsert(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("program_id"), F.col("event_id").alias("last_slot"),
        F.col("event_type").alias("last_signature"), (F.col("event_type") == "click").alias("old"))
    state, batch = [rows.where(F.col("old") == side).drop("old") for side in (True, False)]
    path = new_path(spark, "state")
    for part in (state, batch):
        spread = part.withColumn("bucket", F.pmod(F.xxhash64("program_id"), F.lit(8)).cast("int"))
        tables.upsert_partitions(spark, path, spread, ["program_id"], ["last_slot", "last_signature"], "bucket")
    return tables.read_upserted(spark, path, spread.schema, "bucket").select("program_id", "last_slot", "last_signature")


@query(f"""WITH {SQL_IX} SELECT {', '.join(IX_COLUMNS)} FROM (SELECT *, row_number() OVER (
  PARTITION BY transaction_signature, outer_index ORDER BY slot % 24, indexed_at, part, price, program_id, instruction_name) AS n FROM ix) WHERE n = 1""")
def ledger_compact(spark, sf):
    """Two dozen batches, each of which comes a second time as well; folders are merged on the way."""
    path, landed, rows = new_path(spark, "compacted"), new_path(spark, "landed"), fx.instructions(spark, sf)
    order = ["indexed_at", "part", "price", "program_id", "instruction_name"]
    tables.write_batch(rows.withColumn("turn", F.col("slot") % 24), landed, 0, ("turn",))
    for batch_id in range(24):
        batch = tables.read_or_empty(spark, f"{landed}/batch_id=0/turn={batch_id}", rows.schema)
        tables.write_ledger(batch, path, batch_id, IX_KEY, order)
        tables.write_ledger(batch, path, batch_id, IX_KEY, order)
    return tables.read_ledger(spark, path, rows.schema).select(*IX_COLUMNS)


def order_files(spark: SparkSession, sf: str, turns: tuple[int, ...],
                records: Callable[[DataFrame], DataFrame] = fx.raw_transactions_of) -> DataFrame:
    """Orders as a stream that lands in turns, by a third of the keys each."""
    orders = fx.table(spark, sf, "orders")
    return records(fx.landed_stream([orders.where(F.col("o_orderkey") % 3 == turn) for turn in turns], "orders"))


def tx_stream(spark: SparkSession, sf: str, turns: tuple[int, ...], more_fee: int) -> DataFrame:
    """Each record twice in a batch, once with a higher fee."""
    raw = order_files(spark, sf, turns)
    raw = raw.withColumn("fee", F.explode(F.array("fee", F.col("fee") + more_fee)))
    return raw.select("signature", "slot", F.lit("desk").alias("program_id"), F.col("err").isNull().alias("success"),
                      F.col("fee").cast("bigint").alias("fee"),
                      tables.slot_bucket(F.col("slot")).alias("slot_bucket"))


def ingested(spark: SparkSession, sf: str) -> tuple[ingest.Sink, DataFrame]:
    """History and live stream both bring every order, in different batches, and with conflicts inside each batch."""
    sink = ingest.Sink(new_path(spark, "ingest"), ("signature",), ("slot", "fee"), prune="slot_bucket")
    history, live = tx_stream(spark, sf, (0, 1, 2), 7), tx_stream(spark, sf, (2, 0, 1), 5)
    ingest.run_ingest(history, live, sink).awaitTermination()
    return sink, ingest.ingested(spark, sink, history.schema)


@query(f"""WITH {SQL_TX} SELECT signature, slot, success, fee FROM tx""")
def stream_equals_batch(spark, sf):
    return ingested(spark, sf)[1].select("signature", "slot", "success", "fee")


@query("""SELECT 'desk' AS program_id, max(o_orderkey) AS last_slot, CAST(max(o_orderkey) AS VARCHAR) AS last_signature
FROM orders""")
def sync_state(spark, sf):
    state = ingest.sync_state(spark, ingested(spark, sf)[0])
    return state.select("program_id", "last_slot", "last_signature")


@query("SELECT max(o_orderkey) AS last_slot, CAST(max(o_orderkey) AS VARCHAR) AS last_signature FROM orders")
def last_processed(spark, sf):
    return tables.last_processed(ingest.sync_state(spark, ingested(spark, sf)[0]), "desk")


@query("""SELECT 'snapshot' AS source, CAST(user_id AS VARCHAR) AS pubkey, event_id AS slot, TIMESTAMP '2024-02-01' AS observed_at FROM events
WHERE event_type = 'view' UNION ALL SELECT 'tx', CAST(user_id AS VARCHAR), event_id, TIMESTAMP '2024-02-02' FROM events WHERE event_type = 'click'""")
def append_states(spark, sf):
    """Two observations appended; one of them is written twice under its number."""
    path, states = new_path(spark, "states"), fx.account_states(spark, sf).select("account_type", "pubkey", "slot")
    times = {"snapshot": "2024-02-01", "tx": "2024-02-02"}
    for number, kind, source in ((0, "view", "snapshot"), (1, "click", "tx"), (1, "click", "tx")):
        rows = states.where(F.col("account_type") == kind).drop("account_type")
        tables.append_states(rows, path, number, source, F.lit(times[source]).cast("timestamp"))
    kinds = T.StructType([T.StructField("pubkey", T.StringType()), T.StructField("slot", T.LongType()),
                          T.StructField("source", T.StringType()), T.StructField("observed_at", T.TimestampType())])
    return tables.read_batches(spark, path, kinds).select("source", "pubkey", "slot", ntz(F.col("observed_at")).alias("observed_at"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{"a":' || p_size || '}' END AS args,
CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'unknown' END AS decode_status FROM part""")
def decode_named_unknown(spark, sf):
    """A definition that is called like rows without one."""
    face = parse_interface({"address": "fixture", "metadata": {"name": "fixture"}, "instructions": [
        {"name": "unknown", "discriminator": [9] * 8, "args": [{"name": "a", "type": "u8"}]}]})
    head = F.when(F.col("p_partkey") % 2 == 0, F.lit(b"\x09" * 8)).otherwise(F.lit(b"\x08" * 8))
    rows = fx.table(spark, sf, "part").select("p_partkey", F.lit("fixture").alias("program_id"),
                                              F.concat(head, fx.le(F.col("p_size"), 1)).alias("data"))
    return dc.decode_all(dispatch(rows, [face]), [face]).select("p_partkey", "args", "decode_status")


@query("""SELECT p_partkey, true AS same, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS shown FROM part""")
def decode_json_paths(spark, sf):
    """An f32 in JSON is the same number whether its layout is compiled or, for a list of texts beside it, walked."""
    fields = [{"name": "rate", "type": "f32"}]
    plain, mixed = [fx.one_layout("rates", more) for more in (fields, [*fields, {"name": "names", "type": {"vec": "string"}}])]
    single = F.col("p_retailprice").cast("float")
    rows = fx.table(spark, sf, "part").select("p_partkey", F.concat(
        fx.disc("rates"), fx.pack((single, "<f4")), F.lit(b"\x01\x00\x00\x00\x01\x00\x00\x00x")).alias("data"))
    shown = []
    for at, face in enumerate((plain, mixed)):
        decoded = dc.decode_table(rows, face, face.instructions[0], keep=["p_partkey"], json_column="j")
        shown.append(decoded.select("p_partkey", F.get_json_object("j", "$.rate").cast("double").alias(f"rate{at}")))
    both = shown[0].join(shown[1], "p_partkey")
    return both.select("p_partkey", (F.col("rate0") == F.col("rate1")).alias("same"), F.col("rate1").alias("shown"))


@query(f"WITH {SQL_FLAT} SELECT {SQL_FLAT_COLUMNS} FROM flat")
def nested_roundtrip(spark, sf):
    raw = fx.raw_transactions(spark, sf)
    path = new_path(spark, "nested")
    nested = fl.nested_ledger(raw)
    tables.write_batch(nested, path, 0)
    return flat_columns(fl.ledger_instructions(tables.read_batches(spark, path, nested.schema)))


@query(f"""WITH {SQL_FLAT} SELECT CAST(o_orderkey AS VARCHAR) AS transaction_signature, o_orderpriority AS note, o_orderkey AS "order"
FROM flat WHERE name = 'note'""")
def typed_table_scan(spark, sf):
    """One typed table read back from the dispatched rows, which are partitioned by program and name."""
    path = new_path(spark, "dispatched")
    rows = dispatched(spark, sf).where(F.col("program_id").isNotNull())
    stored = rows.withColumn("program_id", hexed(F.col("program_id"))) \
        .select("transaction_signature", "outer_index", "inner_index", "instruction_index", "data", "program_id", "name", "matched")
    tables.write_dispatched(stored, path, 0)
    part = tables.read_batches(spark, path, stored.schema).where(
        (F.col("program_id") == fx.DESK.hex()) & (F.col("name") == "note") & F.col("matched"))
    face = desk()
    rows = dc.decode_table(part, face, face.find("instruction", "note"), keep=["transaction_signature"])
    return rows.select("transaction_signature", F.col("text").alias("note"), F.col("order").cast("bigint").alias("order"))


# ---- streams ----------------------------------------------------------------

@query(SQL_DECODED)
def stream_decode(spark, sf):
    """The same decode chain on a stream of raw transactions."""
    rows = dc.decode_ledger(fx.raw_transactions_of(fx.table_stream(spark, sf, "orders")), [desk()])
    return fx.drain(rows.select("transaction_signature", "outer_index", minus("inner_index"), "name", "args"), "decoded")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(spark, sf):
    rows = fx.table_stream(spark, sf, "events").select("event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return fx.drain(ingest.dedup_stream(rows, ["event_type", "user_id"], "ts", "60 days"), "dedup") \
        .select("event_type", "user_id")


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, event_type AS instruction_name, count(*) AS count
FROM events GROUP BY 1, 2""")
def stream_buckets(spark, sf):
    rows = fx.table_stream(spark, sf, "events").select(F.col("event_type").alias("instruction_name"),
                                                       F.col("ts").alias("indexed_at"))
    path = new_path(spark, "buckets")
    buckets.write_buckets(buckets.stream_buckets(rows, "hour", "60 days"), path).awaitTermination()
    return buckets.read_buckets(spark, path).withColumn("period", ntz(F.col("period")))


@query("""WITH l AS (SELECT event_type, user_id, max(event_id) AS slot, arg_max(value, ts) AS value, arg_max(props, ts) AS props
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
o AS (SELECT event_type, user_id, arg_max(value, ts) AS value, arg_max(props, ts) AS props
  FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2)
SELECT upper(substr(l.event_type, 1, 1)) || substr(l.event_type, 2) AS name, CAST(l.user_id AS VARCHAR) AS pubkey, l.slot
FROM l LEFT JOIN o USING (event_type, user_id)
WHERE o.value IS NULL OR o.value <> l.value OR o.props <> l.props""")
def snapshot_delta(spark, sf):
    events = fx.table(spark, sf, "events")
    past = events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    previous = snapshot.digest(wallet_states(spark, sf, past).where("matched"))
    changed = snapshot.snapshot_job(fx.raw_accounts_of(events), [wallets()], previous, ["wallets"])
    return changed.select("name", "pubkey", "slot")


SNAPSHOTS = ("2024-01-10", "2024-01-20", "2024-03-01")


@query(f"""WITH cuts(i, cut) AS (VALUES {', '.join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(SNAPSHOTS))}),
s AS (SELECT i, event_type, user_id, arg_max(event_id, ts) AS slot, arg_max(CAST(json_extract(props, '$.k') AS INTEGER), ts) AS k,
  arg_max(value, ts) AS value, max(ts) AS observed_at FROM events JOIN cuts ON ts < cut WHERE event_type <> 'error' GROUP BY ALL),
c AS (SELECT s.* FROM s LEFT JOIN s o ON o.i = s.i - 1 AND o.event_type = s.event_type AND o.user_id = s.user_id
  WHERE o.user_id IS NULL OR o.k <> s.k OR o.value <> s.value)
SELECT 'wallets_' || event_type AS table_name, CAST(user_id AS VARCHAR) AS pubkey, slot, k, value, CASE WHEN k > 50
  THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS label, 'snapshot' AS source, observed_at, k AS k_of_data FROM c""")
def snapshot_states(spark, sf):
    """Three snapshots as a stream, in the typed account tables."""
    events, path = fx.table(spark, sf, "events"), new_path(spark, "snapshots")
    stream = fx.raw_accounts_of(fx.landed_stream([events.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")) for cut in SNAPSHOTS], "accounts"))
    snapshot.run_snapshots(stream, [wallets()], path).awaitTermination()
    out = None
    for layout in wallets().accounts:
        rows = dc.read_derived(spark, layout, f"{path}/tables").select(
            F.lit(table_name(layout)).alias("table_name"), F.col("pubkey").cast("string").alias("pubkey"), "slot", F.col("k").cast("int").alias("k"),
            "value", "label", "source", ntz(F.col("observed_at")).alias("observed_at"), F.variant_get("data", "$.k", "int").alias("k_of_data"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {SQL_FLAT} SELECT name, CAST(o_orderkey AS VARCHAR) AS transaction_signature, outer_index, coalesce(inner_index, -1) AS inner_index,
o_orderkey AS "order", CASE name WHEN 'placeOrder' THEN o_custkey END AS customer, CASE name WHEN 'note' THEN o_orderpriority END AS "text"
FROM flat WHERE program = '{DESK_HEX}' AND name <> 'unknown'""")
def typed_table_rows(spark, sf):
    """All instruction types of a program in their derived tables, written from one pass over the batch."""
    path, face = new_path(spark, "typed"), desk()
    dc.write_derived(dispatched(spark, sf), face, path, 0)
    place, note = [dc.read_derived(spark, face.find("instruction", n), path) for n in ("placeOrder", "note")]
    rows = place.withColumn("name", F.lit("placeOrder")).unionByName(note.withColumn("name", F.lit("note")), allowMissingColumns=True)
    return rows.select("name", "transaction_signature", "outer_index", minus("inner_index"), F.col("order").cast("bigint").alias("order"),
                       F.col("customer").cast("bigint").alias("customer"), "text")


# ---- functions --------------------------------------------------------------

@query("SELECT o_orderkey, sha256('o' || CAST(o_orderkey AS VARCHAR)) AS round_trip, md5(CAST(o_orderkey AS VARCHAR)) AS short_trip FROM orders")
def base58(spark, sf):
    key = fx.key32(F.concat(F.lit("o"), F.col("o_orderkey")))
    short = F.unhex(F.md5(F.col("o_orderkey").cast("string")))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", hexed(unbase58(to_base58(key))).alias("round_trip"), hexed(unbase58(to_base58(short))).alias("short_trip"))


@query("""SELECT doc_id, CASE WHEN lang <> 'de' THEN "text" END AS "text", lang <> 'de' AS good FROM documents""")
def base64(spark, sf):
    raw = F.when(F.col("lang") == "de", F.lit("***")).otherwise(F.base64(F.col("text").cast("binary")))
    return fx.table(spark, sf, "documents").select(
        "doc_id", base64_bytes(raw).cast("string").alias("text"), base64_bytes(raw).isNotNull().alias("good"))


SQL_EMA = """log AS (SELECT event_type AS source, event_id AS seq, value, CAST(json_extract(props, '$.k') AS INTEGER) % 10 <> 0 AS ok
  FROM events),
ranked AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY seq) AS n,
  count(*) OVER (PARTITION BY source) AS total FROM log WHERE ok),
averages AS (SELECT source, 1000 * pow(0.8::DOUBLE, max(total)) + sum(0.2 * value * pow(0.8::DOUBLE, total - n)) AS ema
  FROM ranked GROUP BY source)"""


@query(f"WITH {SQL_EMA} SELECT source, round(ema, 6) AS ema FROM averages")
def ema(spark, sf):
    return health.ema(fx.request_log(spark, sf)).select("source", F.round("ema", 6).alias("ema"))


SQL_EMA_DAYS = SQL_EMA.replace("event_id AS seq", "date_trunc('day', ts) AS seq").replace(
    "ORDER BY seq", "ORDER BY seq, value")


@query(f"WITH {SQL_EMA_DAYS} SELECT source, round(ema, 6) AS ema FROM averages")
def ema_ties(spark, sf):
    """Times that repeat: many requests of a source share a day, and their values settle the order."""
    log = fx.request_log(spark, sf)
    return health.ema(log, order="day").select("source", F.round("ema", 6).alias("ema"))


@query(f"""WITH {SQL_EMA}, counts AS (SELECT source, count(*) FILTER (ok) + 1 AS success_count, count(*) + 1 AS total_count,
  max(seq) FILTER (ok) AS last_slot FROM log GROUP BY source)
SELECT c.source, success_count, total_count, last_slot, round(ema, 6) AS ema,
round(success_count / total_count / greatest(ema, 1.0)
  * CASE WHEN (SELECT max(last_slot) FROM counts) - last_slot > 10 THEN 0.5 ELSE 1.0 END, 9) AS score
FROM counts c JOIN averages USING (source)""")
def source_scores(spark, sf):
    rows = health.source_scores(fx.request_log(spark, sf))
    return rows.withColumn("ema", F.round("ema", 6)).withColumn("score", F.round("score", 9))
