"""Moving average and source ranking against the plain loop."""

import random
import re

import pytest

from slotframe.operators.health import ema, source_scores


@pytest.mark.parametrize("top", [50, 5_000_000_000])
def test_ema_and_scores(spark, top):
    """One source holds most of the log and takes several ranges."""
    rng = random.Random(9)
    seqs = sorted(rng.sample(range(top), 50 if top == 50 else 2000))
    log = [(rng.choice(["a", "a", "a", "b", "slow"]), s, rng.uniform(1, 3000), rng.random() < 0.8) for s in seqs]
    log.append(("down", top, 1.0, False))
    df = spark.createDataFrame([(*r, r[1]) for r in log], "source string, seq bigint, latency_ms double, ok boolean, slot bigint")
    state = {}
    for source, seq, latency, ok in log:
        s = state.setdefault(source, {"ema": 1000.0, "good": 1, "all": 1, "slot": 0})
        s["all"] += 1
        if ok:
            s["ema"] = s["ema"] * 0.8 + latency * 0.2
            s["good"] += 1
            s["slot"] = max(s["slot"], seq)
    got = {r.source: r.ema for r in ema(df).collect()}
    assert got.keys() == state.keys() and all(got[k] == pytest.approx(v["ema"]) for k, v in state.items())
    best = max(s["slot"] for s in state.values())
    score = {k: s["good"] / s["all"] / max(s["ema"], 1.0) * (0.5 if best - s["slot"] > 10 else 1.0) for k, s in state.items()}
    rows = source_scores(df).collect()
    assert [r.source for r in rows] == sorted(score, key=lambda k: (-score[k], k))
    assert all(r.score == pytest.approx(score[r.source]) for r in rows)


def average(rows):
    value = 1000.0
    for _, latency, ok in sorted(r for r in rows if r[2]):
        value = value * 0.8 + latency * 0.2
    return value


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_times_that_repeat_and_missing_values(spark, batch):
    """Ties are settled by value; null keys, times, values and outcomes have a defined result; a key outlasts its batch."""
    rng = random.Random(12)
    log = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, *map(float, range(9))]),
            rng.choice([True, True, None, False])) for _ in range(700)]
    log += [("silent", 1, None, True), ("down", 2, 5.0, False)]
    df = spark.createDataFrame(log, "source string, second int, latency_ms double, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.source: r.ema for r in ema(df, order=["second"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = {r[0] for r in log}
    assert got.keys() == keys
    for k in keys:
        rows = [(-1 if t is None else t, v, ok) for key, t, v, ok in log if key == k and v is not None]
        assert got[k] == pytest.approx(average(rows))
    assert got["silent"] == got["down"] == 1000.0
    assert ema(df.limit(0), order="second").count() == 0


def test_a_busy_key_is_spread(spark):
    """No job runs while the plan is built, and the log is cut by key and time together."""
    log = spark.range(50_000).selectExpr("concat('o', id div 100000) AS source", "id % 50 AS seq", "double(id % 977) AS latency_ms", "true AS ok")
    plan = ema(log)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"rangepartitioning\(key#\d+ ASC NULLS FIRST, o0#", text)
    rows = sorted((r.seq, r.latency_ms, True) for r in log.collect())
    assert plan.collect()[0].ema == pytest.approx(average(rows))
