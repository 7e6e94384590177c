"""Streams that finish their job: late records, snapshots to typed tables, counts on the way."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from slotframe.operators import decode, manifest
from slotframe.operators.dispatch import dispatch
from slotframe.plans.schemas import derive_schemas, table_name, typed_schema
from slotframe.plans.types import parse_interface
from slotframe.streaming import counts, pending, snapshot
from slotframe.streaming.sources import file_stream

RECORD = "signature string, slot bigint, what string"


class Desk:
    """Folders for notifications and records, and one run over what has landed."""

    def __init__(self, spark, at):
        self.spark, self.at = spark, at
        self.schemas = {"notes": "signature string", "records": RECORD}
        for name in self.schemas:
            self.land(name, [])

    def land(self, name, rows):
        self.spark.createDataFrame(rows, self.schemas[name]).coalesce(1).write.mode("append").parquet(f"{self.at}/{name}")

    def run(self, deadline="1 hour"):
        schema = lambda n: self.spark.createDataFrame([], self.schemas[n]).schema
        notes, records = [file_stream(self.spark, f"{self.at}/{n}", schema(n)) for n in self.schemas]
        stored = lambda s: s.read.schema(schema("records")).parquet(f"{self.at}/records")
        pending.follow_notifications(notes, records, stored, f"{self.at}/out", deadline).awaitTermination()
        found = pending.found_records(self.spark, f"{self.at}/out", schema("records"))
        return (sorted(r.signature for r in found.collect()),
                sorted(r.signature for r in pending.waiting_notifications(self.spark, f"{self.at}/out").collect()),
                sorted(r.signature for r in pending.expired_notifications(self.spark, f"{self.at}/out").collect()))


def test_late_records_come_in_later_batches(spark, tmp_path):
    desk = Desk(spark, tmp_path)
    desk.land("records", [("a", 1, "x"), ("a", 1, "x"), ("z", 9, "never asked for")])
    desk.land("notes", [("a",), ("b",), ("b",), ("c",)])
    assert desk.run() == (["a"], ["b", "c"], [])
    desk.land("records", [("b", 2, "y")])
    assert desk.run() == (["a", "b"], ["c"], [])
    desk.land("notes", [("c",), ("z",)])
    assert desk.run() == (["a", "b", "z"], ["c"], [])
    assert desk.run() == (["a", "b", "z"], ["c"], [])  # nothing new has landed
    desk.land("records", [("q", 4, "a tick")])
    assert desk.run("0 seconds") == (["a", "b", "z"], [], ["c"])
    desk.land("records", [("c", 3, "too late")])
    assert desk.run() == (["a", "b", "z"], [], ["c"])


@pytest.mark.parametrize("step", ["append", "replace"])
def test_a_failed_look_is_repeated(spark, tmp_path, monkeypatch, step):
    desk = Desk(spark, tmp_path)
    desk.land("notes", [("a",), ("b",)])
    assert desk.run() == ([], ["a", "b"], [])
    desk.land("records", [("a", 1, "x")])

    def fail(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(manifest, step, fail)
        with pytest.raises(Exception, match="lost"):
            desk.run()
    assert desk.run() == (["a"], ["b"], [])


FACE = {"address": "P", "metadata": {"name": "farm"}, "accounts": [{"name": "Barn"}, {"name": "Pen"}], "types": [
    {"name": "Barn", "type": {"kind": "struct", "fields": [{"name": "slot", "type": "u8"}, {"name": "hayBales", "type": {"vec": "u16"}}]}},
    {"name": "Pen", "type": {"kind": "struct", "fields": [{"name": "mood", "type": {"option": "string"}}]}}],
    "instructions": [{"name": "feedAll", "args": [{"name": "data", "type": "u8"}, {"name": "who", "type": "pubkey"}]}, {"name": "rest"}]}


def accounts(spark, face, rows):
    kinds = {a.name: a.discriminator for a in face.accounts}
    return spark.createDataFrame([(bytearray(k.encode()), "P", bytearray(kinds[kind] + body), n, dt.datetime(2024, 1, n)) for k, kind, body, n in rows],
                                 "pubkey binary, owner string, data binary, slot bigint, observed_at timestamp")


def test_snapshots_end_in_typed_tables(spark, tmp_path, monkeypatch):
    face, at = parse_interface(FACE), str(tmp_path)
    shots = [[("b1", "Barn", b"\x07\x01\x00\x00\x00\x09\x00", 1), ("p1", "Pen", b"\x00", 1)],
             [("b1", "Barn", b"\x07\x01\x00\x00\x00\x09\x00", 2), ("p1", "Pen", b"\x01\x01\x00\x00\x00!", 2), ("p2", "Pen", b"", 2)],
             [("b1", "Barn", b"\x08\x00\x00\x00\x00", 3), ("p1", "Pen", b"\x00", 3), ("p2", "Pen", b"", 3)]]

    def run():
        stream = file_stream(spark, f"{at}/in", accounts(spark, face, []).schema, files_per_trigger=1)
        snapshot.run_snapshots(stream, [face], f"{at}/out").awaitTermination()

    def stored(name):
        rows = decode.read_derived(spark, face.find("account", name), f"{at}/out/tables")
        assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in typed_schema(face.find("account", name))]
        return rows.withColumn("shown", F.to_json("data")).orderBy("slot", "pubkey").collect()
    for n, shot in enumerate(shots):
        accounts(spark, face, shot).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if n == 1:  # the first try of this batch ends after its rows are stored
            with monkeypatch.context() as m:
                m.setattr(snapshot, "upsert_partitions", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(Exception, match="lost"):
                    run()
        run()
    barns, pens = stored("Barn"), stored("Pen")
    assert [(bytes(r.pubkey), r.slot, r.slot_1, r.haybales, r.source, r.observed_at.day, json.loads(r.shown)) for r in barns] == [
        (b"b1", 1, 7, [9], "snapshot", 1, {"slot": 7, "hayBales": [9]}), (b"b1", 3, 8, [], "snapshot", 3, {"slot": 8, "hayBales": []})]
    assert [(bytes(r.pubkey), r.slot, r.mood) for r in pens] == [(b"p1", 1, None), (b"p1", 2, "!"), (b"p2", 2, None), (b"p1", 3, None)]


def test_derived_tables_have_the_derived_schema(spark, tmp_path):
    face, at = parse_interface(FACE), str(tmp_path)
    feed, rest = face.instructions
    rows = spark.createDataFrame(
        [("s1", 0, None, 0, "P", bytearray(feed.discriminator + b"\x05" + bytes(32))), ("s1", 1, 2, 1002, "P", bytearray(rest.discriminator)),
         ("s2", 0, None, 0, "P", bytearray(feed.discriminator + b"\x06")), ("s3", 0, None, 0, "Q", bytearray(rest.discriminator))],
        "transaction_signature string, outer_index int, inner_index int, instruction_index int, program_id string, data binary")
    for _ in range(2):  # a repeated batch changes nothing
        assert decode.write_derived(dispatch(rows, [face]), face, at, 0, indexed_at=F.lit("2024-05-06").cast("timestamp")) == [
            "farm_ix_feedall", "farm_ix_rest"]
    schemas = derive_schemas(face)
    for layout, want in ((feed, [("s1", 5, 32), ("s2", 6, None)]), (rest, [("s1",)])):
        found = decode.read_derived(spark, layout, at)
        assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schemas[table_name(layout)]]
        keys = [r for r in found.orderBy("transaction_signature").collect()]
        assert [(r.transaction_signature, *((r.data, r.who and len(r.who)) if layout is feed else ())) for r in keys] == want
        assert {r.indexed_at for r in keys} == {dt.datetime(2024, 5, 6)}


def test_counts_of_every_batch(spark, tmp_path):
    schema, at = "status string", str(tmp_path)
    for rows in (["ok", "ok", "missing"], ["bad_base64", None, "odd"], ["ok"]):
        spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = file_stream(spark, f"{at}/in", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    writer = counts.CountWriter(spark, "seen", f"{at}/counts")
    spark.streams.addListener(writer)
    try:
        query = counts.observed(stream, "seen", F.col("status")).writeStream.format("noop").option(
            "checkpointLocation", f"{at}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        writer.wait(query)
    finally:
        spark.streams.removeListener(writer)
    found = counts.read_counts(spark, f"{at}/counts")
    assert {r.status: r.n for r in found.groupBy("status").agg(F.sum("records").alias("n")).collect()} == {
        "ok": 3, "missing": 1, "bad_base64": 1, "other": 2}
    assert {r.batch_id for r in found.collect()} == {0, 1, 2}
    assert counts.read_counts(spark, f"{at}/none").count() == 0
