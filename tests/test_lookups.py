"""States at a slot against brute force; joins."""

import random

import pytest

from pyspark.sql import functions as F

from slotframe.operators import lookups
from slotframe.sources import ledger


@pytest.fixture()
def hot(spark):
    """One account holds a third of all rows and spreads over many blocks."""
    rng = random.Random(5)
    keys = ["hot"] * 5 + list("abcdefghij")
    states = [(rng.choice(keys), rng.randrange(40000), i) for i in range(900)]
    touched = [(rng.choice(keys + ["none"]), rng.randrange(40000)) for _ in range(1200)] * 2
    return states, touched


def test_asof_matches_brute_force(spark, hot):
    states, touched = hot
    got = lookups.account_state_at(spark.createDataFrame(touched, "pubkey string, slot bigint"),
                                   spark.createDataFrame(states, "pubkey string, slot bigint, v int"))
    newest = {}
    for k, s, v in states:
        newest[k, s] = max(v, newest.get((k, s), -1))
    expected = []
    for k, s in touched:
        slots = [t for (key, t) in newest if key == k and t <= s]
        if slots:
            expected.append((k, s, max(slots), newest[k, max(slots)]))
    assert sorted((r.pubkey, r.slot, r.state_slot, r.v) for r in got.collect()) == sorted(expected)


def test_latest_matches_brute_force(spark, hot):
    states, touched = hot
    got = lookups.account_state_at(spark.createDataFrame(touched, "pubkey string, slot bigint"),
                                   spark.createDataFrame(states, "pubkey string, slot bigint, v int"), "latest")
    newest = {}
    for k, s, v in states:
        newest[k] = max((s, v), newest.get(k, (-1, -1)))
    assert sorted((r.pubkey, r.slot, r.state_slot, r.v) for r in got.collect()) == sorted(
        (k, s, *newest[k]) for k, s in touched if k in newest)
    with pytest.raises(ValueError):
        lookups.account_state_at(got, got, "other")


def test_scans(spark):
    df = spark.createDataFrame([(i // 2, str(i)) for i in range(10)], "slot bigint, signature string")
    assert ledger.scan_slots(df, 1, 2).count() == 4
    with pytest.raises(ValueError):
        ledger.scan_slots(df, 2, 1)
    seen, before = [], None
    while True:
        part = ledger.keyset_page(df, 3, before=before, until=(0, "0")).collect()
        if not part:
            break
        seen += [r.signature for r in part]
        before = (part[-1].slot, part[-1].signature)
    assert seen == [str(i) for i in range(9, 0, -1)]
    assert [r.signature for r in ledger.backfill(df, (3, "6"), oldest_first=True).collect()] == ["7", "8", "9"]
    assert ledger.backfill(df, None).count() == 10
    owners = spark.createDataFrame([("x",), ("x",)], "program_id string")
    accounts = spark.createDataFrame([("x", 1), ("y", 2)], "owner string, n int")
    assert ledger.scan_accounts(accounts, owners).count() == ledger.scan_accounts(accounts, ["x"]).count() == 1


def test_slot_range_prunes_partitions_and_reaches_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from slotframe.operators.tables import slot_bucket
    df = spark.range(0, 4_000_000, 1000).select(F.col("id").alias("slot")).withColumn("slot_bucket", slot_bucket(F.col("slot")))
    df.write.partitionBy("slot_bucket").parquet(str(tmp_path / "b"))
    rows = ledger.scan_slots(spark.read.parquet(str(tmp_path / "b")), 500_000, 600_000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(slot,500000)" in plan and "slot_bucket" in plan.split("PartitionFilters")[1][:120]
    assert len(rows.inputFiles()) > 0 and rows.count() == 101


def test_latest_state_of_a_busy_account(spark):
    """Nine tenths of all touches are of one account; they are not gathered in one task."""
    touched = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, "busy").otherwise(F.concat(F.lit("a"), F.col("id") % 700)).alias("pubkey"),
                                         F.col("id").alias("slot"))
    states = touched.select("pubkey").distinct().select("pubkey", F.lit(5).cast("bigint").alias("slot"), F.concat("pubkey", F.lit("!")).alias("data"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = lookups.account_state_at(touched, states, mode="latest").withColumn("task", F.spark_partition_id()).persist()
        largest = max(r["count"] for r in rows.groupBy("task").count().collect())
        assert rows.count() == 60_000 and rows.where("data <> concat(pubkey, '!') or state_slot <> 5").count() == 0
        assert largest < 2 * 60_000 / 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
