"""Streams over several files and batches, with duplicates, restarts and late records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotframe.operators.dispatch import dispatch
from slotframe.plans.types import parse_interface
from slotframe.streaming import buckets, ingest, snapshot
from slotframe.streaming.sources import file_stream, missing_notifications, stream_filter

ROW = "signature string, slot bigint, program_id string, fee bigint"


def put(spark, folder, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def start(spark, tmp_path, sink):
    schema = spark.createDataFrame([], ROW).schema
    streams = [file_stream(spark, str(tmp_path / d), schema, files_per_trigger=1) for d in ("history", "live")]
    ingest.run_ingest(*streams, sink).awaitTermination()
    return sorted((r.signature, r.fee) for r in ingest.ingested(spark, sink, schema).collect())


def test_ingest_over_restarts(spark, tmp_path):
    sink = ingest.Sink(str(tmp_path / "sink"), ("signature",), ("slot", "fee"))
    put(spark, tmp_path / "history", [("a", 1, "p", 1), ("b", 2, "p", 2)])
    put(spark, tmp_path / "history", [("b", 2, "p", 9), ("c", 30, "q", 3)])
    put(spark, tmp_path / "live", [("c", 30, "q", 3), ("d", 40, "p", 4), ("d", 40, "p", 4)])
    assert [s for s, _ in start(spark, tmp_path, sink)] == ["a", "b", "c", "d"]
    # A record far older than everything stored still arrives, and progress stays where it was.
    put(spark, tmp_path / "live", [("a", 1, "p", 1), ("old", 0, "p", 5)])
    assert [s for s, _ in start(spark, tmp_path, sink)] == ["a", "b", "c", "d", "old"]
    state = {r.program_id: (r.last_slot, r.last_signature) for r in ingest.sync_state(spark, sink).collect()}
    assert state == {"p": (40, "d"), "q": (30, "c")}
    assert start(spark, tmp_path, sink) == start(spark, tmp_path, sink)


def test_a_failed_batch_is_repeated_without_loss(spark, tmp_path, monkeypatch):
    sink = ingest.Sink(str(tmp_path / "sink"), ("signature",), ("slot", "fee"))
    put(spark, tmp_path / "history", [("a", 1, "p", 1)])
    put(spark, tmp_path / "live", [("a", 1, "p", 1), ("b", 2, "p", 2)])
    real = ingest.progress
    monkeypatch.setattr(ingest, "progress", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path, sink)
    monkeypatch.setattr(ingest, "progress", real)
    assert start(spark, tmp_path, sink) == [("a", 1), ("b", 2)]
    assert ingest.sync_state(spark, sink).first().last_slot == 2


def test_live_counts_equal_batch_counts(spark, tmp_path):
    schema = "indexed_at timestamp, instruction_name string"
    t0 = dt.datetime(2024, 1, 1, 10)
    for part in range(3):
        put(spark, tmp_path / "in", [(t0 + dt.timedelta(minutes=17 * i + part), "ab"[i % 2]) for i in range(12)], schema)
    stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    buckets.write_buckets(buckets.stream_buckets(stream, "hour", "2 days"), str(tmp_path / "out")).awaitTermination()
    got = {(r.period, r.instruction_name): r["count"] for r in buckets.read_buckets(spark, str(tmp_path / "out")).collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.date_trunc("hour", "indexed_at").alias("p"), "instruction_name").count()
    assert got == {(r.p, r.instruction_name): r["count"] for r in batch.collect()} and sum(got.values()) == 36


def test_dedup_within_a_horizon(spark, tmp_path):
    schema = "k string, ts timestamp"
    t0 = dt.datetime(2024, 1, 1)
    for rows in ([("a", t0), ("a", t0)], [("a", t0 + dt.timedelta(minutes=5)), ("b", t0)]):
        put(spark, tmp_path / "in", rows, schema)
    stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    query = (ingest.dedup_stream(stream, ["k"], "ts", "1 hour").writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_filters(spark):
    rows = [("1", False, None, "confirmed", [bytearray(b"x")]), ("2", True, None, "confirmed", [bytearray(b"x")]),
            ("3", False, "e", "finalized", [bytearray(b"y")]), ("4", False, None, "processed", [bytearray(b"x")])]
    df = spark.createDataFrame(rows, "signature string, is_vote boolean, err string, commitment string, account_keys array<binary>")

    def got(**kw):
        return [r.signature for r in stream_filter(df, **kw).collect()]
    assert got() == ["1", "3"] and got(failed=True) == ["3"] and got(failed=False) == ["1"]
    assert got(include=[b"x"]) == ["1"] and got(vote=None, commitment=None) == ["1", "2", "3", "4"]
    known = spark.createDataFrame([("1",)], "signature string")
    assert sorted(r.signature for r in missing_notifications(df, known).collect()) == ["2", "3", "4"]


def test_snapshot_stores_changes_only(spark):
    face = parse_interface({"address": "P", "metadata": {"name": "m"}, "instructions": [],
                            "accounts": [{"name": "A", "discriminator": [1] * 8}]})
    schema = "pubkey string, owner string, data binary, slot bigint, observed_at timestamp"
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]

    def rows(*pairs):
        return spark.createDataFrame([(k, "P", bytearray(b"\x01" * 8 + v), None, w) for k, v, w in pairs], schema)
    first = rows(("a", b"1", t[0]), ("a", b"2", t[1]), ("b", b"1", t[0]))
    stored = snapshot.digest(dispatch(first.withColumnRenamed("owner", "program_id"), [face], "account"))
    now = rows(("a", b"2", t[3]), ("b", b"9", t[2]), ("b", b"2", t[3]), ("c", b"1", t[3])).union(
        spark.createDataFrame([("x", "P", bytearray(b"?"), None, t[3])], schema))
    changed = snapshot.snapshot_job(now, [face], stored)
    assert sorted((r.pubkey, bytes(r.data[8:])) for r in changed.collect()) == [("b", b"2"), ("c", b"1")]
    assert snapshot.snapshot_job(first, [face], stored).count() == 0
    assert snapshot.snapshot_job(now, [face], stored, program_ids=["other"]).count() == 0


def test_a_batch_keeps_its_stamp(spark, tmp_path):
    sink = ingest.Sink(str(tmp_path / "sink"), ("signature",), ("slot",))
    first = ingest.batch_stamp(spark, sink, 3)
    assert ingest.batch_stamp(spark, sink, 3) == first < ingest.batch_stamp(spark, sink, 4)


def test_a_turn_lands_in_many_files_and_one_micro_batch(spark, monkeypatch):
    """A turn that lands as one file is written and read by one task, however many rows it has."""
    from pyspark.sql import functions as F

    from slotframe import fixtures as fx
    from slotframe.session import new_path

    monkeypatch.setattr(fx, "LANDED_ROWS", 10)
    rows, seen = spark.range(90).select("id", (F.col("id") % 3).alias("turn")), []
    stream = fx.landed_stream([rows.where(F.col("turn") == t) for t in (2, 0, 1)], "turns").withColumn("file", F.col("_metadata.file_path"))

    def look(batch, batch_id):
        found = batch.collect()
        seen.append(({r.turn for r in found}, len(found), len({r.file for r in found})))

    stream.writeStream.foreachBatch(look).option("checkpointLocation", new_path(spark, "check")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert seen == [({2}, 30, 3), ({0}, 30, 3), ({1}, 30, 3)]
