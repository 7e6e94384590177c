"""Exact top-k inner products of integer vectors, longest vectors first.

Components are cut to integers, so scores are exact. Spark sorts all vectors by descending length into bands. Every
query is scored against the longest vectors; its k-th best score there is its first threshold, and a band whose
longest vector times the query's own length stays under it can hold no answer. So each team of queries meets a prefix
of the bands only, piece by piece, in tasks of bounded size.

Inside a task vectors come in tiles of descending length. They and the queries are rotated by the singular vectors of
the whole table, which puts most of an inner product into its first terms: after each quarter of the
terms, what is left is bounded by the lengths of both remainders (Cauchy-Schwarz), and pairs that cannot reach the
query's threshold drop out. The others are scored on the integers, and thresholds rise. Bounds have room for rounding, so
nothing is lost; rotation and thresholds only decide how much is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import stored

SCALE = 256
LEAD = 512
"""Leading components that are rotated; further ones stay as they are."""
STAGES = 4
SEEDS, SEED_BYTES = 2048, 8 << 20
PIECE, LARGE_PIECE, PIECE_BYTES = 4096, 1 << 16, 64 << 20
"""Vectors in a piece: a 64th of the table within these bounds, fewer if they have very many components."""
TEAM, LARGE_TEAM = 4096, 1 << 14
BANDS = 4096
"""Bands of vectors, and of queries, whose longest lengths the driver holds; in larger tables bands have several pieces."""
TILE, TILE_BYTES = 2048, 16 << 20
MOST = 2.0 ** 62


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, is_query) to id, components as packed 32-bit integers, length, is_query."""
    for batch in batches:
        lists = batch.column(1)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
        square = np.bincount(np.repeat(np.arange(len(size)), size), cells * cells, len(size))
        if (square >= MOST).any():
            raise ValueError(f"vector {batch.column(0)[int(np.argmax(square))]} is too long for scores of 64 bits")
        ends = np.append(0, np.cumsum(4 * size)).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(cells.astype(np.int32))])
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(np.sqrt(square)), batch.column(2)],
                                         ["id", "cells", "length", "is_query"])


def unpacked(cells: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows, shorter ones with zeros behind."""
    out = np.zeros((len(cells), width), np.int32)
    for row, packed in zip(out, cells):
        row[: len(packed) // 4] = np.frombuffer(packed, np.int32)
    return out


def products(lead: int) -> object:
    """The sum of outer products of all vectors of a partition, their first ``lead`` components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lead, lead))
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                x = unpacked([c[: 4 * lead] for c in batch.column(0).slice(at, TILE).to_pylist()], lead).astype(float)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sum"])
    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            own = np.frombuffer(packed)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sum"])


def rotation(base: DataFrame, lead: int) -> np.ndarray:
    """Right singular vectors of the table, strongest first: eigenvectors of the sum of outer products, added up in Spark."""
    sums = base.select("cells").mapInArrow(products(lead), "sum binary")
    found = sums.repartition(32).mapInArrow(added, "sum binary").coalesce(1).mapInArrow(added, "sum binary").first()
    if not lead or found is None:
        return np.eye(lead)
    return np.ascontiguousarray(np.linalg.eigh(np.frombuffer(found["sum"]).reshape(lead, lead))[1][:, ::-1])


def rotated(x: np.ndarray, basis: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in the rotated basis, and for each stage the length of what follows it."""
    lead = len(basis)
    out = np.hstack([x[:, :lead] @ basis, x[:, lead:]])
    rest = np.array([np.einsum("ij,ij->i", out[:, e:], out[:, e:]) for e in ends]).reshape(len(ends), len(x)).T
    return out, np.sqrt(rest)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products; sums of doubles are exact as long as no part of a sum can reach 2^52."""
    square = lambda v: np.einsum("ij,ij->i", v.astype(float), v.astype(float)).max(initial=0.0)
    if square(q) * square(x) < 2.0 ** 104:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def exact_pairs(q: np.ndarray, x: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    step = max(1, TILE_BYTES // (16 * max(1, q.shape[1])))
    parts = [np.einsum("ij,ij->i", q[at[i: i + step]].astype(np.int64), x[to[i: i + step]].astype(np.int64))
             for i in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Best:
    """The k best of each query so far, by falling score and rising id."""

    def __init__(self, queries: int, k: int, threshold: np.ndarray):
        self.k, self.known = k, np.zeros((3, 0), np.int64)
        self.score = threshold.copy()
        self.last = np.full(queries, np.iinfo(np.int64).max)
        """The id at the k-th place: of those with the threshold's score only smaller ones still matter."""

    def take(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        ok = (score > self.score[at]) | ((score == self.score[at]) & (ids < self.last[at]))
        held = np.hstack([self.known, np.stack([at[ok], ids[ok], score[ok]])])
        held = held[:, np.lexsort((held[1], -held[2], held[0]))]
        first = np.searchsorted(held[0], held[0])
        place = np.arange(held.shape[1]) - first
        full = held[:, place == self.k - 1]
        self.known = held[:, place < self.k]
        self.score[full[0]], self.last[full[0]] = full[2], full[1]


def meet(k: int, width: int, basis: np.ndarray) -> object:
    """A team of queries against a piece of the vectors."""
    ends = sorted({-(-width * i // STAGES) for i in range(1, STAGES)} - {0, width})
    tile = max(1, min(TILE, TILE_BYTES // (8 * max(1, width))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = left.select(["id", "cells", "length", "threshold"]), right.select(["id", "cells", "length"]).sort_by([("length", "descending"), ("id", "ascending")])
        x_ids, x_long, x_cells = held.column("id").to_numpy(), held.column("length").to_numpy(), held.column("cells").to_pylist()
        x_size = np.fromiter(map(len, x_cells), np.int64, len(x_cells))
        out = [np.zeros((3, 0), np.int64)]
        for begin in range(0, asked.num_rows, tile):
            own = asked.slice(begin, tile)
            q_cells = own.column("cells").to_pylist()
            q, q_ids, q_long = unpacked(q_cells, width), own.column("id").to_numpy(), own.column("length").to_numpy()
            q_size = np.fromiter(map(len, q_cells), np.int64, len(q_cells))
            q_turned, q_rest = rotated(q.astype(float), basis, ends)
            least = pc.fill_null(own.column("threshold"), np.iinfo(np.int64).min).to_numpy()
            best = Best(len(q), k, least)
            for at in range(0, len(x_ids), tile):
                cut = slice(at, at + tile)
                room = 1e-9 * x_long[at] * q_long + 1e-6
                rows = np.flatnonzero(q_long * x_long[at] + room >= best.score)
                if not len(rows):
                    break  # vectors only get shorter from here on
                x = unpacked(x_cells[cut], width)
                x_turned, x_rest = rotated(x.astype(float), basis, ends)
                columns = np.arange(len(x))
                alive = (q_size[rows][:, None] == x_size[cut][None, :]) & (q_ids[rows][:, None] != x_ids[cut][None, :])
                part, before = np.zeros(alive.shape), 0
                for stage, end in enumerate(ends):
                    part += q_turned[rows, before:end] @ x_turned[columns, before:end].T
                    before = end
                    bound = part + q_rest[rows, stage][:, None] * x_rest[columns, stage][None, :]
                    alive &= bound + room[rows][:, None] >= best.score[rows][:, None]
                    r, c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                    if len(r) * len(c) < 0.75 * alive.size:
                        rows, columns, alive, part = rows[r], columns[c], alive[np.ix_(r, c)], part[np.ix_(r, c)]
                r, c = np.nonzero(alive)
                if len(r) * 8 > alive.size:
                    score = exact(q[rows], x[columns])[r, c]
                else:
                    score = exact_pairs(q, x, rows[r], columns[c])
                best.take(rows[r], x_ids[cut][columns[c]], score)
            found = best.known
            out.append(np.stack([q_ids[found[0]], found[1], found[2]]) if found.shape[1] else found)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), np.hstack(out))))
    return run


def seeded(ids: np.ndarray, cells: list[bytes], k: int, width: int) -> object:
    """Adds to each query its k-th best score among the longest vectors; null if it meets fewer than k there."""
    x, size = unpacked(cells, width), np.fromiter(map(len, cells), np.int64, len(cells))
    tile = max(1, min(TILE, TILE_BYTES // (8 * max(1, width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, tile):
                batch = whole_batch.slice(at, tile)
                packed = batch.column(1).to_pylist()
                score = exact(unpacked(packed, width), x)
                own = np.fromiter(map(len, packed), np.int64, len(packed))
                ok = (own[:, None] == size[None, :]) & (batch.column(0).to_numpy()[:, None] != ids[None, :])
                score[~ok] = np.iinfo(np.int64).min
                score = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(packed), np.iinfo(np.int64).min)
                known = score > np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=~known)], ["id", "cells", "length", "threshold"])
    return run


def banded(rows: DataFrame, total: int, piece: int, order: list[Column], value: str) -> tuple[DataFrame, list[tuple[int, float]], int]:
    """The rows written with a band in the given order and a piece within it; the extreme ``value`` of each band, and the pieces of one."""
    bands = max(1, min(BANDS, -(-total // piece)))
    pieces = max(1, -(-total // (bands * piece)))
    rows = rows.repartitionByRange(bands, *order)
    rows = stored(rows.withColumn("band", F.spark_partition_id()).withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int")), "bands")
    pick = F.max if value == "length" else F.min
    return rows, sorted((r["band"], r["edge"]) for r in rows.groupBy("band").agg(pick(value).alias("edge")).collect()), pieces


def top_products(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that ``queries`` marks, the k other rows of highest score: query_id, rank, vec_id, score.

    The score is the inner product of floor(256 * x) of all components, exact; ties go to the smaller vec_id. Fewer
    than k candidates: all of them. Rows take no part, neither as queries nor as candidates, if their id or vector is
    null or a component is null or not finite. Zero vectors take part. Rows that share an id count once, with the
    smallest of their vectors (as arrays are ordered), and as a query if one of them is marked. Vectors of different
    lengths are not compared. If a vector is so long that scores might not fit 64 bits, an error names it.
    Empty input: no rows.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          F.coalesce(queries, F.lit(False)).alias("is_query"))
    base = base.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad)
    base = base.groupBy("id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query"))
    base = stored(base.mapInArrow(whole, "id long, cells binary, length double, is_query boolean"), "vectors")
    size = base.agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked"), F.max(F.length("cells")).alias("bytes")).first()
    width = (size["bytes"] or 0) // 4
    fit = max(64, PIECE_BYTES // (4 * max(1, width)))
    basis = rotation(base, min(width, LEAD))

    ranked, longest, pieces = banded(base, size["n"], min(fit, LARGE_PIECE, max(PIECE, size["n"] // 64)), [F.desc("length"), F.col("id")], "length")
    most = max(k + 1, min(SEEDS, SEED_BYTES // (8 * max(1, width))))
    seeds = base.orderBy(F.desc("length"), "id").limit(most).select("id", "cells").collect()  # bounded by SEED_BYTES
    asked = base.where("is_query").select("id", "cells", "length").mapInArrow(
        seeded(np.array([r["id"] for r in seeds], np.int64), [bytes(r["cells"]) for r in seeds], k, width),
        "id long, cells binary, length double, threshold long")
    # how long a vector must be to matter to a query
    need = F.when((F.col("length") > 0) & F.col("threshold").isNotNull(), F.col("threshold") / F.col("length")).otherwise(float("-inf"))
    asked, needs, parts = banded(asked.withColumn("need", need), size["asked"], min(fit, LARGE_TEAM, max(TEAM, size["asked"] // 8)),
                                 [F.col("need"), F.col("id")], "need")

    # Bands fall in length and teams rise in need, so each meets a prefix of the other.
    meets = lambda need, length: need <= length * (1 + 1e-9) + 1e-6
    reach = {team: max((band + 1 for band, length in longest if meets(need, length)), default=0) for team, need in needs}
    visits = {band: max((team + 1 for team, need in needs if meets(need, length)), default=0) for band, length in longest}

    def prefix(counts: dict[int, int], each: int) -> Column:
        most = F.element_at(F.lit([counts.get(i, 0) for i in range(max(counts, default=0) + 1)]), F.col("band") + 1)
        return F.when(most > 0, F.sequence(F.lit(0), most * each - 1))

    left = asked.select((F.col("band") * parts + F.col("piece")).alias("team"), F.explode(prefix(reach, pieces)).alias("part"),
                        "id", "cells", "length", "threshold")
    right = ranked.select((F.col("band") * pieces + F.col("piece")).alias("part"), F.explode(prefix(visits, parts)).alias("team"),
                          "id", "cells", "length")
    found = left.groupBy("team", "part").cogroup(right.groupBy("team", "part")).applyInArrow(
        meet(k, width, basis), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
