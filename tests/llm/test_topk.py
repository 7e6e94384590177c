"""Exact top-k inner products against brute force in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id string, length double, band int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 3) for i, v in rows], SCHEMA)


def brute(rows, k, step):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = [float(np.float32(x)) for x in v]
            good[i] = min(good.get(i, v), v)
    cells = {i: [math.floor(256 * x) for x in v] for i, v in good.items()}
    out = set()
    for q, x in cells.items():
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in cells.items() if i != q and len(x) == len(y))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def found(spark, rows, k=5, step=50):
    return [tuple(r) for r in topk.top_products(frame(spark, rows), F.col("vec_id") % step == 0, k)
            .select("query_id", "rank", "vec_id", "score").collect()]


@pytest.fixture
def small(monkeypatch):
    """Many bands, pieces, teams and tiles on few rows."""
    for name, value in (("PIECE", 40), ("LARGE_PIECE", 40), ("TEAM", 8), ("LARGE_TEAM", 8), ("BANDS", 5), ("TILE", 16), ("SEEDS", 32)):
        monkeypatch.setattr(topk, name, value)


def vectors(kind, n=900, d=20):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)) * 0.2
    if kind == "skewed lengths":
        x *= rng.lognormal(0, 1.5, size=(n, 1))
    if kind == "few directions":
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, d)) + 0.05 * x
    if kind == "ties":
        x = rng.integers(-1, 2, size=(n, d)) / 8
    if kind == "one vector":
        x[: n // 2] = x[0]
    if kind == "all negative":
        x = np.vstack([np.abs(x[: n // 2]), -np.abs(x[n // 2:])])
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["plain", "skewed lengths", "few directions", "ties", "one vector", "all negative"])
def test_same_as_brute_force(spark, small, kind):
    rows = vectors(kind)
    got = found(spark, rows, step=20)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 20)


def test_odd_rows(spark, small):
    rows = vectors("plain", 120)
    rows += [(200, None), (250, []), (251, []), (300, [0.0] * 20), (None, rows[0][1]), (350, [float("nan")] + [0.0] * 19),
             (400, [None] * 20), (450, [float("inf")] * 20), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (550, [0.5] * 700), (551, [0.25] * 700),
             rows[3], rows[3], (50, rows[60][1]), (7, rows[61][1])]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 50)
    assert found(spark, []) == [] and found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (3, [-2.0])]) == [(50, 1, 3, -256 * 512)]


def test_large_components(spark, small):
    """Beyond the whole numbers of doubles scores stay exact; what 64 bits cannot hold is refused."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * 1e6).tolist()) for i in range(150)]
    assert set(found(spark, rows)) == brute(rows, 5, 50)
    with pytest.raises(Exception, match="too long for scores"):
        found(spark, rows + [(999, [1e30] * 6)])


def test_most_pairs_are_pruned(spark, monkeypatch):
    """Where few directions hold most of the length, first terms decide: hardly any pair is scored in full."""
    rows = vectors("few directions", 2000, 32)
    scored = []
    monkeypatch.setattr(topk, "exact_pairs", lambda q, x, at, to, f=topk.exact_pairs: scored.append(len(at)) or f(q, x, at, to))
    held = [(i, np.floor(256 * np.float32(v).astype(float)).astype(np.int32)) for i, v in rows]
    basis = np.linalg.eigh(sum(np.outer(v, v.astype(float)) for _, v in held))[1][:, ::-1]
    import pyarrow as pa
    long = [float(np.sqrt((v.astype(float) ** 2).sum())) for _, v in held]
    side = pa.table({"id": [i for i, _ in held], "cells": [v.tobytes() for _, v in held], "length": long, "threshold": pa.array([None] * 2000, pa.int64())})
    out = topk.meet(5, 32, basis)(side.take(list(range(0, 2000, 50))), side)
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in out.to_pylist()} == {(q, i, s) for q, _, i, s in brute(rows, 5, 50)}
    assert sum(scored) < 0.2 * 40 * 2000
