"""Keyed table maintenance."""

import random
import re

import pytest
from pyspark.sql import functions as F

from slotframe.operators import manifest, tables
from slotframe.operators.tables import (append_states, bridge, first_by, insert_if_absent, last_processed, latest_by, progress,
                                        read_batches, read_ledger, slot_bucket, upsert, upsert_partitions, write_batch,
                                        write_ledger)

ROWS = "signature string, slot bigint, fee bigint"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_insert_if_absent_keeps_the_first_of_each_new_key(spark):
    batch = spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("b", 2, 9), ("c", 3, None), ("c", 3, 1)], ROWS)
    stored = spark.createDataFrame([("b", 2, 1)], ROWS)
    assert sorted(insert_if_absent(batch, stored, ["signature"], ["fee"]).collect(), key=str) == sorted(
        [("a", 1, 4), ("c", 3, None)], key=str)
    assert insert_if_absent(batch.limit(0), stored, ["signature"], ["fee"], prune="slot").count() == 0


def test_first_by_with_unorderable_columns(spark):
    df = spark.sql("select k, n, parse_json(v) as v from values (1, 2, '{}'), (1, 1, '[1]') as t(k, n, v)")
    row = first_by(df, ["k"], ["n"]).first()
    assert (row.n, row.v.toPython()) == (1, [1])


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    b = [spark.createDataFrame(r, ROWS).withColumn("slot_bucket", slot_bucket(F.col("slot"))) for r in (
        [("a", 1, 1), ("a", 1, 2), ("b", 10 ** 6, 3)], [("b", 10 ** 6, 7), ("c", 3, 3)], [("a", 1, 9)])]
    args = dict(key=["signature"], order=["fee"], prune="slot_bucket", partition_by=("slot_bucket",))
    for i in (0, 0, 1, 1, 0, 2, 1):
        write_ledger(b[i], path, i, **args)
    schema = b[0].schema
    assert rows(read_ledger(spark, path, schema).select("signature", "fee", "batch_id")) == [
        ("a", 1, 0), ("b", 3, 0), ("c", 3, 1)]
    assert read_ledger(spark, path, schema, before=1).count() == 2


def test_upsert_orders(spark):
    schema = "k string, last_slot bigint"
    target = spark.createDataFrame([("a", 5), ("b", 5)], schema)
    batch = spark.createDataFrame([("a", 3), ("b", 9), ("b", 8), ("c", 1)], schema)
    assert rows(upsert(target, batch, ["k"], ["last_slot"])) == [("a", 5), ("b", 9), ("c", 1)]
    assert rows(upsert(target, batch, ["k"], ["last_slot"], monotonic=False)) == [("a", 3), ("b", 9), ("c", 1)]


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path, schema = str(tmp_path / "u"), "k string, n bigint, p int"
    upsert_partitions(spark, path, spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], schema), ["k"], ["n"], "p")
    batch = spark.createDataFrame([("a", 4, 0), ("c", 2, 0)], schema)
    upsert_partitions(spark, path, batch, ["k"], ["n"], "p")
    stored = tables.read_upserted(spark, path, batch.schema, "p")
    assert rows(stored.select("k", "n", "p")) == [("a", 4, 0), ("b", 1, 1), ("c", 2, 0)]
    assert {n for n in manifest.names_in(spark, f"{path}/data/version=1") if n.startswith("p=")} == {"p=0"}


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_failed_upsert_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    path, schema = str(tmp_path / "u"), "k string, n bigint, p int"
    first = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], schema)
    upsert_partitions(spark, path, first, ["k"], ["n"], "p")
    batch = spark.createDataFrame([("a", 4, 0), ("b", 0, 1), ("c", 2, 5)], schema)

    def fail(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(manifest, "size_of" if step == "write" else "commit", fail)
        with pytest.raises(RuntimeError, match="lost"):
            upsert_partitions(spark, path, batch, ["k"], ["n"], "p")
    stored = lambda: rows(tables.read_upserted(spark, path, first.schema, "p").select("k", "n", "p"))
    assert stored() == [("a", 1, 0), ("b", 1, 1)]
    upsert_partitions(spark, path, batch, ["k"], ["n"], "p")
    assert stored() == [("a", 4, 0), ("b", 1, 1), ("c", 2, 5)]


def test_progress(spark):
    df = spark.createDataFrame([("p", 3, "x"), ("p", 5, "a"), ("p", 5, "b"), ("q", 1, "z")],
                               "program_id string, slot bigint, signature string")
    state = progress(df, F.lit(None).cast("timestamp"))
    assert rows(state.drop("updated_at")) == [("p", 5, "b"), ("q", 1, "z")]
    assert rows(last_processed(state, "p")) == [(5, "b")] and last_processed(state, "new").count() == 0


def test_bridge_and_states(spark, tmp_path):
    a, b = spark.createDataFrame([("a", 1, 1)], ROWS), spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], ROWS)
    assert rows(bridge(a, b)) == [("a", 1, 1), ("b", 2, 2)]
    append_states(a, str(tmp_path / "s"), 0, "snapshot", F.lit("2024-01-01").cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "s")).first().source == "snapshot"
    with pytest.raises(ValueError):
        append_states(a, str(tmp_path / "s"), 0, "else", F.lit(None))
    write_batch(a, str(tmp_path / "w"), 3)
    assert read_batches(spark, str(tmp_path / "none"), a.schema).count() == 0


def test_a_batch_reads_only_its_own_buckets(spark, tmp_path):
    """Buckets at both ends of the table: what lies between is not read, which a min..max range would do."""
    path = str(tmp_path / "ledger")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("signature"), F.col("id").alias("slot"),
                                    (F.col("id") / 100).cast("int").alias("bucket"))
    tables.write_ledger(rows, path, 0, ["signature"], ["slot"], prune="bucket")
    batch = rows.where("slot < 50 or slot >= 950").unionByName(spark.createDataFrame([("new", 960, 9)], rows.schema))
    tables.write_ledger(batch, path, 1, ["signature"], ["slot"], prune="bucket")
    stored = tables.read_ledger(spark, path, rows.schema)
    assert stored.count() == 1001 and stored.where("batch_id = 1").count() == 1
    before = tables.read_ledger(spark, path, rows.schema, before=1)
    part = tables.covered(before, batch, "bucket")
    assert part.count() == 200
    filters = re.search(r"PartitionFilters: \[(.*?)\]", part._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "IN (" in filters and "0" in filters and "9" in filters


def test_many_buckets_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tables, "LISTED", 3)
    target = spark.range(100).selectExpr("id", "id % 10 as bucket")
    batch = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, None)], "id long, bucket long")
    assert tables.covered(target, batch, "bucket").count() == 40
    assert tables.covered(target, batch.limit(3), "bucket").count() == 30


def test_only_a_missing_path_counts_as_empty(spark, tmp_path):
    schema = spark.range(0).schema
    assert tables.read_or_empty(spark, str(tmp_path / "nothing"), schema).count() == 0
    (tmp_path / "text").write_text("no table")
    with pytest.raises(Exception):
        tables.read_or_empty(spark, str(tmp_path / "text"), schema).count()


def test_latest_rows_in_two_phases(spark):
    """One account holds a third of all rows; ties, nulls and columns without an order."""
    rng = random.Random(6)
    given = [(rng.choice(["hot", "hot", *"abcdef", None]), rng.choice([None, *range(4)]), rng.choice([None, *range(3)]), rng.choice("xyz"))
             for _ in range(600)] + [("only nulls", None, 1, "x"), ("only nulls", None, None, "y")]
    df = spark.createDataFrame(given, "k string, at long, then int, what string").withColumn("v", F.parse_json(F.lit("{}")))
    found = latest_by(df, ["k"], ["at", "then"])
    low = lambda v: (v is not None, v if v is not None else 0)
    want = {k: max((r for r in given if r[0] == k), key=lambda r: (low(r[1]), low(r[2]), r[3])) for k in {r[0] for r in given}}
    assert {tuple(r)[:4] for r in found.collect()} == set(want.values()) and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "LeftSemi" in plan


# ---- manifests --------------------------------------------------------------

def batches(spark, count):
    return [spark.createDataFrame([(f"s{(7 * i + j) % 40}", i, j) for j in range(5)], ROWS) for i in range(count)]


def test_merging_keeps_rows_and_few_folders(spark, tmp_path):
    path, kept = str(tmp_path / "m"), {}
    for i, batch in enumerate(batches(spark, 30)):
        write_ledger(batch, path, i, ["signature"], ["fee"])
        for r in batch.collect():
            kept.setdefault(r.signature, (r.signature, r.slot, r.fee, i))
        assert len(manifest.segments(spark, path)) <= manifest.FANOUT
    assert rows(read_ledger(spark, path, batch.schema)) == sorted(kept.values())
    # every version can still be read
    assert rows(read_ledger(spark, path, batch.schema, before=11)) == sorted(r for r in kept.values() if r[3] < 11)
    gone = manifest.unlisted(spark, path, 29)
    assert gone and not set(gone) & {s.folder for s in manifest.segments(spark, path)}


def test_replays_after_merging(spark, tmp_path):
    """A batch that comes again, also after its folder has been merged away, changes nothing."""
    path, given = str(tmp_path / "m"), batches(spark, 12)
    for i, batch in enumerate(given):
        write_ledger(batch, path, i, ["signature"], ["fee"])
        write_ledger(given[max(0, i - 1)], path, max(0, i - 1), ["signature"], ["fee"])
    before, names = rows(read_ledger(spark, path, batch.schema)), manifest.versions(spark, path)
    for i in (11, 3, 0):
        write_ledger(given[i], path, i, ["signature"], ["fee"])
    assert rows(read_ledger(spark, path, batch.schema)) == before and manifest.versions(spark, path) == names


@pytest.mark.parametrize("step", ["write_segment", "commit"])
def test_failures_leave_the_last_version(spark, tmp_path, monkeypatch, step):
    path, given = str(tmp_path / "m"), batches(spark, manifest.FANOUT + 2)
    for i, batch in enumerate(given[:-1]):
        write_ledger(batch, path, i, ["signature"], ["fee"], merge=False)
    before = rows(read_ledger(spark, path, batch.schema))

    def fail(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(manifest, step, fail)
        for work in (lambda: write_ledger(given[-1], path, len(given) - 1, ["signature"], ["fee"]),
                     lambda: manifest.compact(spark, path, batch.schema)):
            with pytest.raises(RuntimeError, match="lost"):
                work()
            assert rows(read_ledger(spark, path, batch.schema)) == before
    assert manifest.compact(spark, path, batch.schema) > 1 and rows(read_ledger(spark, path, batch.schema)) == before


def test_an_old_table_costs_a_batch_no_more(spark, tmp_path, monkeypatch):
    """After a thousand batches a further one reads one manifest and lists the folders in it, nothing else."""
    path, schema = str(tmp_path / "m"), spark.createDataFrame([], ROWS).schema
    listed = []
    for i in range(1000):  # what a thousand batches leave behind, without running them
        listed.append(manifest.Segment(f"data/segment={i}", i, i, 100))
        if len(listed) > manifest.FANOUT:
            count = manifest.to_merge(listed)
            listed[-count:] = [manifest.Segment(f"data/segment=m{i}", listed[-count].first, i, sum(s.bytes for s in listed[-count:]))]
        assert len(listed) <= manifest.FANOUT
    assert sum(s.bytes for s in listed) == 100_000 and listed[0].first == 0
    for s in listed:
        spark.createDataFrame([(f"s{s.first}", s.first, 1, s.last)], ROWS + ", batch_id long").coalesce(1).write.parquet(f"{path}/{s.folder}")
    for i in range(1000):
        manifest.put_once(spark, f"{path}/manifest/{manifest.version_name(i)}", "[]" if i < 999 else manifest.json.dumps([manifest.asdict(s) for s in listed]))
    read = []
    monkeypatch.setattr(manifest, "get_text", lambda spark, at, f=manifest.get_text: read.append(at) or f(spark, at))
    batch = spark.createDataFrame([("s0", 5, 1), ("new", 5, 1)], ROWS)
    write_ledger(batch, path, 1000, ["signature"], ["fee"], merge=False)
    assert len({n for n in read if n.endswith(manifest.version_name(999))}) == 1 and len(set(read)) == 2
    stored = read_ledger(spark, path, schema)
    assert stored.count() == len(listed) + 1 and len(stored.inputFiles()) <= len(listed) + 1


def test_ledger_batches_do_not_read_the_whole_table_each(spark, monkeypatch):
    """Two dozen batches land once; each used to read all line items for its own part of them."""
    from slotframe import catalog

    read = []
    monkeypatch.setattr(catalog.tables, "write_ledger", lambda batch, *rest: read.append(batch.inputFiles()))
    catalog.QUERIES["ledger_compact"](spark, "/root/testdata/sf0.001")
    assert len(read) == 48 and any(read)
    assert not [f for files in read for f in files if "lineitem" in f]
