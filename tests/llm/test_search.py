"""Neighbours and archives against brute force and round trips."""

import gzip
import hashlib
import os
import random

import numpy as np
from pyspark.sql import functions as F

from slotframe.llm import ann, warc


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            best = {}
            for i, y in good:
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -np.inf), float((x * y).sum()))
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, id string, score double")


def recall(spark, rows, k=20):
    want = brute([(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows], k)
    got = {}
    for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        found = [got[q][n] for n in sorted(got[q])] if w else []
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == len(w)
        hits += len({i for i, _ in found} & {i for i, _ in w})
        total += len(w)
    return hits / total


def test_clusters_and_noise(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24)) * 3
    clustered = [(i, (centres[i % 30] + rng.normal(size=24) * 0.3).tolist()) for i in range(3000)]
    assert recall(spark, clustered) >= 0.9
    assert recall(spark, [(i, rng.normal(size=24).tolist()) for i in range(1500)]) >= 0.9


def test_few_blocks_suffice_for_clusters():
    places = [{i: i // 10 for i in range(1000)}, {i: (i * 7 % 1000) // 10 for i in range(1000)}, {i: i // 10 for i in range(1000)}]
    assert ann.choose_reach(places, [(i, i + 3) for i in range(0, 900, 7)], 100) == (2, 1)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]),
            (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (40, [3.0, 2.0, 1.0])]
    assert recall(spark, rows) == 1.0
    got = [(r.query_id, r.vec_id) for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1), (0, 2), (0, 20), (20, 1), (20, 2), (20, 0), (40, 9)]
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_rows_of_one_id_push_no_others_out():
    rng = np.random.default_rng(4)
    vectors = np.vstack([np.full((25, 8), 2.0), rng.random((60, 8))])
    ids = np.array([7] * 25 + [100 + i // 2 for i in range(60)])
    scores = {int(i): vectors[ids == i].sum(1).max() for i in set(ids.tolist())}
    found = ann.best_of(np.ones((1, 8)), np.array([1]), vectors, ids, 20)
    assert found[0][0].tolist() == sorted(scores, key=lambda i: (-scores[i], i))[:20]


def test_repeated_ids(spark, monkeypatch):
    """A table that holds all its rows twice, with two vectors for each id, and an id with a third of all rows."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i % 600, (centres[i % 20] + rng.normal(size=16) * 0.3).tolist()) for i in range(1200)]
    hot = [(5001, (centres[i % 20] + rng.normal(size=16) * 0.3).tolist()) for i in range(600)]
    assert recall(spark, rows + rows + hot) >= 0.9


def test_hilbert_neighbours_are_adjacent():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    key = ann.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")


def test_round_trip(spark):
    body = "é" * 700 + "\r\nWARC/1.1\r\nx\n\r\n\r\n"
    rows = [(1, "http://a.org/x", body), (2, "http://b.org/", body), (5, "http://a.org/x", body), (3, "http://a.org/\r\ny", "short"), (4, None, "short"),
            (6, "", ""), (7, "http://c.org", None), (None, "http://a.org/x", body), (5, "http://a.org/x", body), (8, "http://d.org", "z" * 300_000)]
    captured = F.timestamp_seconds(1_600_000_000 - F.coalesce("page_id", F.lit(0)))
    path = warc.write_archives(pages(spark, rows), captured=captured)
    got = warc.capture_index(warc.read_archives(spark, path)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(10)) and all(r.intact for r in got)
    order = [(r.url_key, r.captured, r.page_id or -1) for r in got]
    assert order == sorted(order)
    seen = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got}
    size, digest = len(body.encode()), hashlib.sha1(body.encode()).hexdigest()
    assert {(1, "revisit", 5, size, digest), (2, "revisit", 5, size, digest), (None, "revisit", 5, size, digest), (5, "response", None, size, digest)} <= seen
    assert {(i, t) for i, t, *_ in seen} >= {(3, "response"), (4, "response"), (6, "response"), (7, "response"), (8, "response")}
    whole = b"".join(gzip.open(os.path.join(path.removeprefix("file://"), f)).read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert whole.count(b"WARC-Type: ") == 10 and body.encode() in whole


def test_no_pages(spark):
    path = warc.write_archives(pages(spark, []))
    assert warc.capture_index(warc.read_archives(spark, path)).collect() == []


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        order = list(warc.LoserTree(runs))
        assert [runs[r][i] for r, i in order] == sorted(x for r in runs for x in r)
        assert len(set(order)) == len(order)
