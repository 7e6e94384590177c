"""Nearest neighbours by inner product over several shifted Hilbert orders.

An index fits projections on a bounded sample and gives every vector one key for each curve: its
projection, scaled, shifted by the curve's own offset and numbered along a Hilbert curve. Spark
sorts all keys by range and cuts each curve into blocks of BLOCK consecutive vectors. A query looks into
the blocks around its own on each curve; what they hold is scored on the original vectors in double
precision, and the best of all curves are merged.

How far a query looks (``reach``, in blocks) and how many curves it uses is measured, not set: for a bounded
sample of queries the exact neighbours are found by one pass over all vectors, their places along
the curves are looked up, and the cheapest choice that holds TARGET of them is taken. Where vectors lie
in clusters a few blocks suffice; where they have no structure at all, as random directions in many
dimensions, no order of any kind puts neighbours close, and the reach grows until most blocks are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import stored

CURVES = 4
AXES, BITS = 10, 6
BLOCK = 1024
GROUP = 64
"""Query blocks that visit a block together."""
TARGET = 0.97
SAMPLE_VECTORS, SAMPLE_QUERIES = 4096, 128


@dataclass(frozen=True)
class Curve:
    """For one number of dimensions: ``axes`` project a vector with its extra coordinate, ``middle`` and ``spread`` scale."""

    axes: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    shift: np.ndarray


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows), by the transposed form: undo the turns of each
    level from the coarsest on, Gray-code the axes, then interleave their bits."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(axes):
            turned = (x[i] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[axes - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more coordinate that gives all the same length, so that the largest inner product with a
    query is the smallest distance to it."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.hstack([vectors, rest[:, None]])


def fit_curves(sample: np.ndarray, longest: float, curves: int, seed: int) -> list[Curve]:
    """Random orthogonal views of the directions in which the sample varies most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    data = extended(sample, longest)
    centred = data - data.mean(0)
    _, _, basis = np.linalg.svd(centred, full_matrices=False)
    out = []
    for c in range(curves):
        wide = min(len(basis), AXES * (c + 1))
        turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][: min(AXES, wide)]
        axes = turn @ basis[:wide]
        seen = data @ axes.T
        spread = np.maximum(seen.std(0), 1e-12)
        out.append(Curve(axes, seen.mean(0), spread, rng.random(len(axes))))
    return out


def keys_of(vectors: np.ndarray, longest: float, curve: Curve) -> np.ndarray:
    seen = (extended(vectors, longest) @ curve.axes.T - curve.middle) / (3 * curve.spread)
    unit = (np.clip((seen + 1) / 2, 0, 1) + curve.shift) / 2
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.array(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def keyed(longest: dict[int, float], curves: dict[int, list[Curve]]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in by_dimension(whole):
                vectors = matrix(batch.column(1))
                for c, curve in enumerate(curves[dim]):
                    n = len(vectors)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, c, np.int32)),
                         pa.array(keys_of(vectors, longest[dim], curve)), batch.column(0), batch.column(2)], ["dim", "curve", "key", "id", "row"])
    return run


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dim, curve, row) with the part they are in and, within it, the number of their block."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        dim, curve = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.zeros(batch.num_rows, np.int64)
        for d, c in set(zip(dim.tolist(), curve.tolist())):
            own = np.flatnonzero((dim == d) & (curve == c))
            at[own] = seen.get((d, c), 0) + np.arange(len(own))
            seen[d, c] = seen.get((d, c), 0) + len(own)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array((at // BLOCK).astype(np.int32))],
            ["dim", "curve", "row", "part", "piece"])


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query, ids, scores and positions of its k best rows, other ids than its own and each id once, best first, ties
    to the smaller id. Missing ones have the id and position -1 and the score -inf. Scores are summed in one fixed
    order, so equal vectors score alike."""
    out_ids, out = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
    places, by_id = np.full((len(queries), k), -1, np.int64), np.argsort(ids, kind="stable")
    begin = np.flatnonzero(np.append(True, ids[by_id][1:] != ids[by_id][:-1]))
    for at in range(0, len(queries), 512):
        rough = queries[at: at + 512] @ vectors.T
        rough[query_ids[at: at + 512][:, None] == ids[None, :]] = -np.inf
        each = rough if len(begin) == len(ids) else np.maximum.reduceat(rough[:, by_id], begin, axis=1)  # the best row of each id
        limit = np.partition(each, -k, axis=1)[:, -k] if each.shape[1] > k else np.full(len(rough), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(limit), limit, 0)))
        for q, some in enumerate(rough >= (limit - slack)[:, None]):
            own = np.flatnonzero(some & np.isfinite(rough[q]))
            exact = (vectors[own] * queries[at + q]).sum(1)
            order = np.lexsort((ids[own], -exact))
            order = order[first_of_each(ids[own][order], k)]
            n = len(order)
            out_ids[at + q, :n], out[at + q, :n], places[at + q, :n] = ids[own][order], exact[order], own[order]
    return out_ids, out, places


def first_of_each(ids: np.ndarray, k: int) -> np.ndarray:
    """Where the first k different ids begin."""
    return np.sort(np.unique(ids, return_index=True)[1])[:k]


def exact_best(queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> object:
    """For sampled queries: the best rows of a part, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for whole in batches:
            for dim, batch in by_dimension(whole):
                if dim not in queries:
                    continue
                names, vectors, _ = queries[dim]
                ids, scores, at = best_of(vectors, names, matrix(batch.column(1)), batch.column(0).to_numpy(), k)
                found = ids, scores, batch.column(2).to_numpy()[at]
                old = best.get(dim)
                best[dim] = merged([old, found], k) if old else found
        for dim, (ids, scores, rows) in best.items():
            q, at = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries[dim][2][q]), pa.array(ids[q, at]), pa.array(rows[q, at]), pa.array(scores[q, at])],
                ["query", "id", "row", "score"])
    return run


def merged(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of several tables of ids and scores, with what else they hold."""
    held = [np.hstack(p) for p in zip(*parts)]
    ids, scores = held[:2]
    out = [np.full((len(ids), k), -np.inf if x is scores else -1, x.dtype) for x in held]
    for q in range(len(ids)):
        own = np.flatnonzero(np.isfinite(scores[q]))
        own = own[np.lexsort((ids[q, own], -scores[q, own]))]
        own = own[first_of_each(ids[q, own], k)]
        for to, x in zip(out, held):
            to[q, : len(own)] = x[q, own]
    return tuple(out)


def choose_reach(places: list[dict[int, int]], pairs: list[tuple[int, int]], blocks: int) -> tuple[int, int]:
    """How many curves, at least two, and how many blocks to either side hold TARGET of the pairs most cheaply.

    ``places``: for each curve, the block of each id.
    """
    if blocks <= 1 or not pairs:
        return min(2, len(places)), max(0, blocks - 1)
    apart = np.array([[abs(p[q] - p[i]) for p in places] for q, i in pairs])
    best = None
    for curves in range(min(2, len(places)), len(places) + 1):
        nearest = np.sort(apart[:, :curves].min(1))
        reach = int(nearest[min(len(nearest) - 1, int(np.ceil(TARGET * len(nearest))) - 1)])
        cost = curves * min(blocks, 2 * reach + 1)
        if best is None or cost < best[0]:
            best = cost, curves, reach
    return best[1], best[2]


def pack(group: pa.Table) -> pa.Table:
    """The rows of a block as one row."""
    group = group.combine_chunks().sort_by("id")
    vectors = matrix(group.column("vector").chunk(0) if group.column("vector").num_chunks else group.column("vector"))
    marks = group.column("is_query").to_numpy().astype(np.uint8)
    ids = group.column("id").to_numpy()
    asked = np.flatnonzero(marks)
    return pa.table({
        "dim": group.column("dim")[:1], "curve": group.column("curve")[:1], "block": group.column("block")[:1],
        "ids": pa.array([ids.tobytes()]), "vectors": pa.array([vectors.tobytes()]),
        "query_ids": pa.array([ids[asked].tobytes()]), "queries": pa.array([vectors[asked].tobytes()])})


def visit(k: int) -> object:
    """A block with the query blocks that visit it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for block in left.to_pylist():
            ids = np.frombuffer(block["ids"], np.int64)
            vectors = np.frombuffer(block["vectors"]).reshape(len(ids), -1)
            for asked in right.to_pylist():
                names = np.frombuffer(asked["query_ids"], np.int64)
                found, scores, _ = best_of(np.frombuffer(asked["queries"]).reshape(len(names), -1), names, vectors, ids, k)
                rows.append((asked["dim"], asked["curve"], asked["home"], asked["query_ids"], found.tobytes(), scores.tobytes()))
        names = ["dim", "curve", "home", "query_ids", "found", "scores"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))})
    return run


def gather(k: int) -> object:
    """What a block of queries has found in all blocks of a curve."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        names = np.frombuffer(rows[0]["query_ids"], np.int64)
        ids, scores = merged([(np.frombuffer(r["found"], np.int64).reshape(-1, k), np.frombuffer(r["scores"]).reshape(-1, k))
                              for r in rows], k)
        row, at = np.nonzero(np.isfinite(scores))
        return pa.table({"query_id": names[row], "vec_id": ids[row, at], "score": scores[row, at]})
    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            curves: int = CURVES, seed: int = 11) -> DataFrame:
    """For each row that ``queries`` marks, its k nearest other rows: query_id, rank, vec_id, score.

    The score is the inner product in double precision; ties go to the smaller vec_id. Rows take no part, neither as
    queries nor as candidates, if their id or vector is null or the vector is empty, zero or has a null or
    non-finite component. Vectors of different lengths are not compared. Rows that share an id are one
    thing with several vectors and count once, by the best of them. Fewer than k candidates: all of them.
    """
    value = F.col("vector").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    base = base.where(F.col("id").isNotNull()).groupBy("id", "vector").agg(F.max("is_query").alias("is_query")).withColumn("vector", value)
    base = base.where(F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    base = stored(base.select("id", "vector", "is_query", F.monotonically_increasing_id().alias("row")), "vectors")

    # Fit: longest vector, a sample of vectors, a sample of queries; all of bounded size.
    dim = F.size("vector")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    longest = {r["dim"]: r["longest"] for r in base.groupBy(dim.alias("dim")).agg(F.max(norm).alias("longest")).collect()}
    order = F.xxhash64("id", "vector", F.lit(seed))
    sample = base.orderBy(order, "id").limit(SAMPLE_VECTORS).select("vector").collect()
    asked = base.where("is_query").orderBy(order, "id").limit(SAMPLE_QUERIES).select("id", "vector", "row").collect()
    fitted = {}
    for d, most in longest.items():
        own = [r["vector"] for r in sample if len(r["vector"]) == d] or [[most] + [0.0] * (d - 1)]
        fitted[d] = fit_curves(np.array(own), most * (1 + 1e-9), curves, seed + d)

    # Places of all vectors along all curves; an id may have several, so each goes by a number of its own.
    keys = base.select("id", "vector", "row").mapInArrow(keyed(longest, fitted), "dim int, curve int, key long, id long, row long")
    keys = keys.repartitionByRange("dim", "curve", "key", "id", "row").sortWithinPartitions("dim", "curve", "key", "id", "row")
    pieces = stored(keys.select("dim", "curve", "row").mapInArrow(cut, "dim int, curve int, row long, part int, piece int"), "pieces")
    numbered = pieces.select("dim", "curve", "part", "piece").distinct().withColumn(
        "block", F.row_number().over(Window.partitionBy("dim", "curve").orderBy("part", "piece")).cast("long") - 1)
    places = stored(pieces.join(numbered, ["dim", "curve", "part", "piece"]).select("dim", "curve", "block", "row"), "places")
    blocks = {(r["dim"], r["curve"]): r["n"] for r in places.groupBy("dim", "curve").agg((F.max("block") + 1).alias("n")).collect()}

    # Measure how far neighbours are along the curves.
    spark = vectors.sparkSession
    chosen = measure(base, places, asked, blocks, curves, k)
    plan = spark.createDataFrame(
        [(d, c, reach, blocks[d, c]) for d, (used, reach) in chosen.items() for c in range(used)],
        "dim int, curve int, reach long, blocks long")

    # Blocks, and the query blocks that visit them.
    used = places.join(F.broadcast(plan), ["dim", "curve"])
    packs = used.join(base, "row").select("dim", "curve", "block", "id", "vector", "is_query").groupBy("dim", "curve", "block").applyInArrow(
        pack, "dim int, curve int, block long, ids binary, vectors binary, query_ids binary, queries binary")
    packs = stored(packs, "blocks").join(F.broadcast(plan), ["dim", "curve"])
    lo, hi = F.greatest(F.col("block") - F.col("reach"), F.lit(0)), F.least(F.col("block") + F.col("reach"), F.col("blocks") - 1)
    asking = packs.where("length(query_ids) > 0").select(
        "dim", "curve", F.col("block").alias("home"), "query_ids", "queries", F.expr(f"block div {GROUP}").alias("team"),
        F.explode(F.sequence(lo, hi)).alias("block"))
    asking = asking.toDF(*asking.columns)  # columns of its own, as both sides come from one table
    visited = packs.select("dim", "curve", "block", "ids", "vectors",
                           F.explode(F.sequence(F.expr(f"greatest(block - reach, 0) div {GROUP}"),
                                                F.expr(f"least(block + reach, blocks - 1) div {GROUP}"))).alias("team"))
    by = ["dim", "curve", "block", "team"]
    found = visited.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(
        visit(k), "dim int, curve int, home long, query_ids binary, found binary, scores binary")
    found = found.groupBy("dim", "curve", "home").applyInArrow(gather(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measure(base: DataFrame, places: DataFrame, asked: list, blocks: dict, curves: int, k: int) -> dict[int, tuple[int, int]]:
    """For each number of dimensions: curves to use, and reach in blocks."""
    spark = base.sparkSession
    queries = {}
    for d in {len(r["vector"]) for r in asked}:
        own = [r for r in asked if len(r["vector"]) == d]
        queries[d] = np.array([r["id"] for r in own], np.int64), np.array([r["vector"] for r in own]), np.array([r["row"] for r in own], np.int64)
    pairs = []
    if queries:
        best = base.select("id", "vector", "row").mapInArrow(exact_best(queries, k), "query long, id long, row long, score double")
        best = best.groupBy("query", "id").agg(F.max("score").alias("score"), F.max_by("row", "score").alias("row"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        pairs = [(r["query"], r["row"]) for r in best.withColumn("rank", rank).where(F.col("rank") <= k).collect()]
    rows = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p})], "row long")
    where: dict[tuple[int, int], dict[int, int]] = {}
    for r in places.join(F.broadcast(rows), "row").collect():  # at most (k + 1) * SAMPLE_QUERIES * CURVES
        where.setdefault((r["dim"], r["curve"]), {})[r["row"]] = r["block"]
    out = {}
    for d in {d for d, _ in blocks}:
        own = [where.get((d, c), {}) for c in range(curves)]
        near = [(q, i) for q, i in pairs if all(q in p and i in p for p in own)]
        out[d] = choose_reach(own, near, max(blocks[d, c] for c in range(curves)))
    return out
