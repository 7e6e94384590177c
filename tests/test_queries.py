"""Pages, totals, buckets and metrics."""

import pytest
from pyspark.sql import functions as F

from slotframe.operators import queries
from slotframe.operators.decode import populate
from slotframe.plans.schemas import TRANSACTIONS, type_name


@pytest.fixture()
def tx(spark):
    return spark.createDataFrame([(str(i), i // 2, i % 3 > 0) for i in range(9)], "signature string, slot bigint, success boolean")


def test_pages_cover_everything_once(tx):
    order = queries.TRANSACTION_ORDER
    seen = [r.signature for o in range(0, 12, 4) for r in queries.page(tx, order, 4, o).data.collect()]
    assert seen == [str(i) for i in range(8, -1, -1)]
    assert tuple(queries.page(tx, order, 4, 4).envelope.first()) == (9, 4, 4, True)
    assert tuple(queries.page(tx, order, 5, 4).envelope.first()) == (9, 5, 4, False)
    assert tuple(queries.page(tx, order).envelope.first()) == (9, 50, 0, False)
    assert queries.page(tx, order, 9999).envelope.first().limit == 9999
    assert [queries.service_limit(n) for n in (None, 7, 9999)] == [50, 7, 500]
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            queries.page(tx, order, *bad)


def test_pages_are_top_n_plans(tx):
    plan = queries.page(tx, queries.TRANSACTION_ORDER, 4, 4).data._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_unknown_account_type(tx):
    with pytest.raises(KeyError):
        queries.filter_accounts({"A": tx}, "a")


def test_filters(tx):
    assert queries.filter_transactions(tx, success=False).count() == 3
    assert [r.signature for r in queries.filter_transactions(tx, signature="4", slot_from=2, slot_to=2).collect()] == ["4"]


def test_totals_of_empty_tables(spark):
    empty = spark.createDataFrame([], TRANSACTIONS)
    assert tuple(queries.stats(empty, empty).first()) == (0, 0, 0, 0, None)
    text = "".join(r.rendered for r in queries.metrics(empty, empty).collect())
    assert text.splitlines()[:3] == ["# HELP indexer_transactions_total Total indexed transactions",
                                     "# TYPE indexer_transactions_total gauge", "indexer_transactions_total 0"]
    assert text.endswith("indexer_latest_slot 0\n")


def test_buckets(spark):
    df = spark.sql("select cast(t as timestamp) as indexed_at, n as instruction_name from values "
                   "('2024-01-01 10:00:00','a'), ('2024-01-01 10:59:59','a'), ('2024-01-01 11:00:00','a'), ('2024-01-02 00:00:00','b') as v(t, n)")
    assert [(str(r.period), r.instruction_name, r["count"]) for r in queries.instruction_buckets(df, "week").collect()] == [
        ("2024-01-02 00:00:00", "b", 1), ("2024-01-01 11:00:00", "a", 1), ("2024-01-01 10:00:00", "a", 2)]
    ranged = queries.instruction_buckets(df, "day", from_time="2024-01-01T10:59:59Z", to_time="2024-01-01 11:00:00+00:00")
    assert [r["count"] for r in ranged.collect()] == [2]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        queries.instruction_buckets(df, from_time="soon").collect()


def test_populate_matches_sanitised_names(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("lastslot", T.LongType()), T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame([('{"lastSlot": 5, "n": 1}',)], "j string")
    assert tuple(df.select(populate(F.col("j"), schema, ["lastSlot", "n"])).first()[0]) == (5, 1)


def test_type_names(spark):
    df = spark.createDataFrame([('{"option":{"vec":"pubkey"}}',), ("u64",), (None,)], "t string")
    assert [r[0] for r in df.select(type_name(F.col("t"))).collect()] == ["array<binary>", "decimal(20,0)", None]
