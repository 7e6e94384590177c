"""Plan shapes: no cross joins, nothing shuffled without need, filters where they belong."""

import pytest

import __spark_entry__ as entry
from slotframe import fixtures as fx
from slotframe.catalog import QUERIES, desk
from slotframe.operators.decode import decode_ledger, decode_table

SF = "/root/testdata/sf0.001"
STREAMS = ("stream", "enrich", "sync_state", "upsert", "nested", "typed_table")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(STREAMS)])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_decode_chain_is_narrow(spark, tmp_path):
    fx.raw_transactions(spark, SF).write.parquet(str(tmp_path / "raw"))
    text = plan(decode_ledger(spark.read.parquet(str(tmp_path / "raw")), [desk()]))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("name", ["decode_fixed", "decode_string", "decode_vec", "decode_all", "flatten_outer", "flatten_inner", "typed_ix"])
def test_decode_queries_do_not_shuffle(spark, name):
    assert "Exchange hashpartitioning" not in plan(QUERIES[name](spark, SF))


def test_slot_range_reaches_both_scans(spark):
    text = plan(QUERIES["ix_with_tx"](spark, SF))
    assert "GreaterThanOrEqual(l_orderkey,100)" in text and "GreaterThanOrEqual(o_orderkey,100)" in text


def test_filters_on_kept_columns_reach_the_scan(spark, tmp_path):
    fx.text_payloads(spark, SF).selectExpr("data", "length(data) as slot").write.parquet(str(tmp_path / "p"))
    face = fx.TEXTS
    rows = decode_table(spark.read.parquet(str(tmp_path / "p")), face, face.instructions[0], keep=["slot"])
    assert "GreaterThan(slot,100)" in plan(rows.where("slot > 100"))


def test_filters_on_decoded_columns_do_not_multiply(spark, tmp_path):
    fx.text_payloads(spark, SF).write.parquet(str(tmp_path / "p"))
    face = fx.TEXTS
    rows = decode_table(spark.read.parquet(str(tmp_path / "p")), face, face.instructions[0], keep=[])
    assert plan(rows.where("decode_status <> 'ok'")).count("conv(") <= plan(rows).count("conv(")
    assert "conv(" not in plan(rows.select("decode_status").where("decode_status = 'x'").limit(1)).split("Generate")[0]


def test_unused_columns_are_not_read(spark):
    text = plan(entry.queries()["buckets_day"](spark, SF))
    assert "l_extendedprice" not in text and "l_partkey" not in text


def test_definitions_of_one_file_are_read_by_many_tasks(spark):
    """Definitions of a small file are one split; reading them all in one task took the time of all together."""
    from pyspark.sql import functions as F

    from slotframe.plans.schemas import schema_table

    documents = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("program_id"),
                                                    F.lit('{"name":"sync","accounts":[{"name":"State"}]}').alias("json"))
    found = schema_table(documents)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    # the definition's own table is called like one of the core tables, and takes its place
    tables = {r.table_name: r["count"] for r in found.groupBy("table_name").count().collect()}
    assert tables == {"sync_state": 7 * 200, "transactions": 7 * 200, "instructions": 12 * 200}
