"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on whole shingle sets.

Texts with equal shingle sets form a class; one document stands for it. TREES orders of its
signature, each a head of DEPTH values and a tail of further ones, are sorted in Spark by range. Runs
with an equal head are regions of the forest; where a region has over REGION members, it is cut
where the common prefix of tails is longer, so dense regions use deeper prefixes. Inside a region each
member finds its longest-common-prefix neighbour and its smallest neighbour among those whose
tails agree well enough. These few pairs for each document are confirmed on the whole sets, and
components follow. Then every head that still holds members of several components gives its pairs
across them: a region that is a whole head those that tails allow, a head that was cut (for its size, or
between two partitions) all that sizes and pictures of whole sets allow, in blocks over tasks. They are
confirmed too. So a link is never missed for being in a large group, and pairs inside a group
that already hangs together are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import join_counted, slices, stored
from slotframe.llm.components import components, joined
from slotframe.llm.shingles import mix64, shingle_sets

TREES, DEPTH, TAIL = 32, 4, 12
VALUES = TREES * DEPTH
REGION = 256
FACE, FACE_BYTES = 2048, 16_000_000
"""Members of a cut head that one task compares with as many others; fewer if their pictures are larger."""
LEAST_AGREE = 5
"""Tail values that must agree; pairs at the threshold of 0.8 pass with 0.9994 in each of their trees."""
SIGMAS = 4.0
_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TAILS = np.array([[(DEPTH * (t + 1) + j * 9) % VALUES for j in range(TAIL)] for t in range(TREES)])
"""Positions of each tree's tail values: constant strides through the signature, past its head."""


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            np.minimum(least, np.multiply.outer(FACTORS, shingles[at: at + 1024]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sign(width: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, digest, signed = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signed.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signed, pa.binary())],
                ["id", "n", "digest", "signature"])
    return run


def hashed_sets(width: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1_000_000):
            sets = list(shingle_sets(batch.column(1).to_pylist(), width))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             ["id", "shingles"])
    return run


def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of each signature: head, tail, id, n."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            signed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, VALUES)
            rows = len(signed)
            head = np.repeat(np.arange(TREES, dtype=np.uint64)[None, :], rows, 0)
            with np.errstate(over="ignore"):
                for k in range(DEPTH):
                    head = mix64(head * np.uint64(0x9E3779B97F4A7C15) + signed[:, k::DEPTH])
            tail = (signed[:, TAILS.ravel()] & np.uint32(255)).astype(np.uint8)
            each = lambda c: pa.array(np.repeat(c.to_numpy(), TREES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(head.ravel().view(np.int64)),
                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(TAIL), rows * TREES, [None, pa.py_buffer(tail.tobytes())]).cast(pa.binary()),
                 each(batch.column(0)), each(batch.column(1))], ["head", "tail", "id", "n"])


def bounds(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Where regions begin: at each new head, deeper where a region would be too large, and at last by position."""
    fresh = np.append(True, head[1:] != head[:-1])
    differ = tail[1:] != tail[:-1]
    for depth in range(TAIL + 1):
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(head)))
        if (size <= REGION).all():
            return begin
        large = np.repeat(size > REGION, size)
        if depth < TAIL:
            fresh |= large & np.append(True, differ[:, : depth + 1].any(1))
    return np.sort(np.concatenate([begin, *[b + np.arange(REGION, s, REGION) for b, s in zip(begin, size) if s > REGION]]))


def parity(shingles: np.ndarray) -> bytes:
    """For each of a power of two of cells, 2 to 4 for each shingle, whether an odd number of shingles falls into it."""
    bits = max(6, 1 + int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.asarray(v) for v in batch.column(1).to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parity(s) for s in sets], pa.binary())], ["id", "picture"])


def may_link(a: bytes | None, b: bytes | None, n: int, percent: int) -> bool:
    """Whether two sets with ``n`` elements in all can be similar enough. The pictures of two sets differ in no more cells
    than the sets in elements, so a pair that is similar enough always passes. Neighbouring cells of the finer picture
    are put together until both have the same cells. Without a picture everything passes."""
    if a is None or b is None:
        return True
    x, y = int.from_bytes(a), int.from_bytes(b)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b, x, y = b, a, y, x
        odd = np.unpackbits(np.frombuffer(a, np.uint8)).reshape(-1, 2)
        a = np.packbits(odd[:, 0] ^ odd[:, 1]).tobytes()
        x = int.from_bytes(a)
    # intersection >= percent * (n - intersection) / 100, and differing = n - 2 * intersection
    return (x ^ y).bit_count() <= n - 2 * -(-percent * n // (100 + percent))


def close_pairs(begin: np.ndarray, tail: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions i < j of one region whose tails agree and whose sizes allow a link, and how many values agree."""
    end = np.repeat(np.append(begin[1:], len(ids)), np.diff(np.append(begin, len(ids))))
    i, step = np.arange(len(ids)), 1
    while len(i := i[i + step < end[i]]):
        j = i + step
        agree = (tail[i] == tail[j]).sum(1)
        ok = (agree >= LEAST_AGREE) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * 80) & (ids[i] != ids[j])
        yield i[ok], j[ok], agree[ok]
        step += 1


def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of the forest to members of regions that have a neighbour: its smallest and its best one. Of heads that
    are cut, and of those that may go on in another partition (both are ``open``), all members; ``best`` is their own id if they
    have no neighbour."""
    part, passed = TaskContext.get().partitionId(), 0

    def found(head: np.ndarray, tail: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        begin = bounds(head, tail)
        least, best, mark = ids.copy(), ids.copy(), np.zeros(len(ids), np.int64)
        seen = np.zeros(len(ids), np.int64)
        for i, j, agree in close_pairs(begin, tail, ids, n):
            np.minimum.at(least, i, ids[j])
            np.minimum.at(least, j, ids[i])
            for x, y in ((i, j), (j, i)):
                more = agree > mark[x]
                best[x[more]], mark[x[more]] = ids[y[more]], agree[more]
                seen[x] = 1
        nonlocal passed
        size = np.diff(np.append(begin, len(ids)))
        number = np.cumsum(np.append(True, head[1:] != head[:-1])) - 1
        open_ = (np.bincount(number[begin]) > 1)[number] | (number == 0) | (number == number[-1])
        kept = np.flatnonzero((seen > 0) | open_)
        # a name of its own for each region, also for the parts of one head in several partitions
        name = mix64(np.repeat((np.int64(part) << 40) + passed + begin, size).view(np.uint64))
        passed += len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(head[kept]), pa.array(name.view(np.int64)[kept]), pa.array([tail[k].tobytes() for k in kept], pa.binary()), pa.array(ids[kept]),
             pa.array(n[kept]), pa.array(least[kept]), pa.array(best[kept]), pa.array(open_[kept])],
            ["head", "region", "tail", "id", "n", "least", "best", "open"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, TAIL),
               batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        last = int(np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))[-1])
        if not last and len(held[0]) >= 100 * REGION:
            last = len(held[0])  # a region this large is cut in any case
        if last:
            yield found(*[x[:last] for x in held])
            held = [x[last:] for x in held] if last < len(held[0]) else None
    if held is not None:
        yield found(*held)


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (region, root, tail, id, n, picture, percent), sorted by region: pairs of different roots that tails, sizes and pictures
    allow."""
    def found(region: np.ndarray, root: np.ndarray, tail: np.ndarray, ids: np.ndarray, n: np.ndarray, picture: np.ndarray,
              percent: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        for i, j, agree in close_pairs(begin, tail, ids, n):
            ok = root[i] != root[j]
            i, j, agree = i[ok], j[ok], agree[ok]
            ok = np.array([may_link(picture[x], picture[y], int(n[x] + n[y]), int(percent[x])) for x, y in zip(i, j)], bool)
            i, j, agree = i[ok], j[ok], agree[ok]
            if len(i):
                less = ids[i] < ids[j]
                a, b = np.where(less, i, j), np.where(less, j, i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[a], ids[b], root[a], root[b], agree)], ["a", "b", "ra", "rb", "agree"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(0).to_numpy(), batch.column(1).to_numpy(),
               np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, TAIL),
               *[batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6)]]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        last = int(np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))[-1])
        if last:
            yield from found(*[x[:last] for x in held])
            held = [x[last:] for x in held]
    if held is not None:
        yield from found(*held)


def halved(pictures: np.ndarray) -> np.ndarray:
    """Pictures (rows of bytes) with half as many cells."""
    odd = np.unpackbits(pictures, axis=1).reshape(len(pictures), -1, 2)
    return np.packbits(odd[:, :, 0] ^ odd[:, :, 1], axis=1)


def facing(percent: int, every: bool) -> object:
    """Some members outside the largest component of a head against some of all its members: the pairs of different roots
    that sizes and pictures allow, or only the likeliest one of any two roots. Without a picture every pair passes."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n, root, main = (right.column(c).to_numpy() for c in ("id", "n", "root", "main"))
        held = right.column("picture").to_pylist()
        size = np.array([len(p or b"") for p in held], np.int64)
        groups = {int(k): np.flatnonzero(size == k) for k in np.unique(size)}
        seen = {(k, k): np.frombuffer(b"".join(held[i] for i in at), np.uint8).reshape(-1, k) for k, at in groups.items() if k}
        row_of = np.zeros(len(ids), np.int64)
        for at in groups.values():
            row_of[at] = np.arange(len(at))
        found: list[list[np.ndarray]] = []
        for x in left.select(["id", "n", "root", "picture"]).to_pylist():
            fits = (root != x["root"]) & (ids != x["id"]) & (np.minimum(n, x["n"]) * 100 >= np.maximum(n, x["n"]) * percent)
            fits &= (root == main) | (ids > x["id"])  # two members outside the largest component meet twice
            for k, at in groups.items():
                at = at[fits[at]]
                if not len(at):
                    continue
                total, differ = n[at] + x["n"], np.zeros(len(at), np.int64)
                if k and x["picture"] is not None:
                    own = np.frombuffer(x["picture"], np.uint8)[None, :]
                    while own.shape[1] > k:
                        own = halved(own)
                    cells = k
                    while cells > own.shape[1]:
                        if (k, cells // 2) not in seen:
                            seen[k, cells // 2] = halved(seen[k, cells])
                        cells //= 2
                    differ = np.bitwise_count((seen[k, cells][row_of[at]] ^ own).view(np.uint64)).sum(1, dtype=np.int64)
                ok = differ <= total - 2 * -(-percent * total // (100 + percent))  # as in may_link
                at, total, differ = at[ok], total[ok], differ[ok]
                same = np.full(len(at), x["id"]), np.full(len(at), x["root"])
                found.append([np.minimum(ids[at], same[0]), np.maximum(ids[at], same[0]), np.minimum(root[at], same[1]),
                              np.maximum(root[at], same[1]), TAIL * (total - differ) / (total + differ)])
        a, b, ra, rb, score = ([np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)])
        if not every:
            order = np.lexsort((b, a, -score, rb, ra))
            a, b, ra, rb, score = (c[order] for c in (a, b, ra, rb, score))
            first = np.append(True, (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1]))[: len(a)]
            a, b, ra, rb, score = (c[first] for c in (a, b, ra, rb, score))
        return pa.table({"a": a, "b": b, "ra": ra, "rb": rb, "score": score})
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    rows = pairs.select("a", "b").join(two, "b").join(one, "a")
    rows = rows.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    return rows.where(F.col("_both") * 100 >= percent * (F.size("_a") + F.size("_b") - F.col("_both"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``width``-word shingles
    (fewer words: all words as one shingle). component_id is the smallest id reachable over links, its own
    at least; ``kept`` marks the rows with component_id = id. Null and empty texts and texts without words have
    no shingles and link with nothing. Repeated rows are copies and get the same result; rows that share an
    id are one document. A row with a null id is in no component (null) and is kept. Empty input: no rows.
    Percentages under 80 make links likelier to be missed; the forest's depth is set for 80 and more.
    """
    ids = F.col(id_col).cast("long")
    signed = stored(docs.select(ids.alias("id"), F.col(text_col).alias("text")).mapInArrow(
        sign(width), "id long, n long, digest binary, signature binary"), "signatures")
    named = signed.where("id is not null and n > 0")
    classes = stored(named.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    alone = named.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")
    trees = alone.select("id", "n", "signature").mapInArrow(plant, "head long, tail binary, id long, n long")
    trees = trees.repartitionByRange("head", "tail", "id").sortWithinPartitions("head", "tail", "id")
    members = stored(trees.mapInArrow(regions, "head long, region long, tail binary, id long, n long, least long, best long, open boolean"), "regions")

    # Few pairs for each document: its smallest neighbour of all trees, and the one it is best with most often.
    seen = members.select("id", F.explode(F.array("least", "best")).alias("other")).where("id <> other")
    seen = seen.groupBy("id", "other").agg(F.count("*").alias("times"))
    seen = seen.groupBy("id").agg(F.min("other").alias("least"), F.max_by("other", F.struct("times", -F.col("other"))).alias("best"))
    few = seen.select("id", F.explode(F.array_distinct(F.array("least", "best"))).alias("other"))
    few = few.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()

    wanted = members.select("id").distinct()
    texts = docs.select(ids.alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sets = stored(texts.join(wanted, "id", "left_semi").mapInArrow(hashed_sets(width), "id long, shingles array<long>"), "sets")
    roots = stored(components(stored(confirmed(few, sets, percent), "confirmed")), "roots")

    # Heads that were cut are compared as a whole, all others by region.
    cut = members.where("open").select("head", "id", "n")
    whole = members.where("not open and best <> id").select("region", "tail", "id", "n")

    # What still lies under one head but not in one component: first the likeliest pair of any two components, then,
    # of what that leaves apart, all pairs.
    for every in (False, True):
        pairs = apart(whole, roots, sets, percent, every).unionByName(beyond(cut, roots, sets, percent, every))
        if not every:
            pairs = pairs.groupBy("ra", "rb").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p")).select("p.a", "p.b")
        pairs = pairs.select("a", "b").distinct()
        roots = joined(roots, stored(confirmed(pairs, sets, percent), "confirmed"))
    return labelled(signed, classes, roots, id_col)


def apart(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, every: bool = True) -> DataFrame:
    """Pairs (a, b) of one region and of different components (ra, rb) that may be similar enough. A picture of each whole set
    bounds how much two of them differ, so a text that is just too different from a large group drops out before it is
    joined with all the group's members. Without ``every`` only pairs whose tails agree well, to find the likeliest first."""
    rooted = members.select("region", "tail", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = stored(rooted.select("region", F.coalesce("root", "id").alias("root"), "tail", "id", "n"), "rooted")
    split = rooted.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region")
    open_ = stored(rooted.join(split, "region", "left_semi"), "open")
    open_ = open_.join(pictured(open_, sets), "id").select("region", "root", "tail", "id", "n", "picture", F.lit(percent).cast("long").alias("percent"))
    open_ = open_.repartition("region").sortWithinPartitions("region", "id")
    pairs = open_.mapInArrow(across, "a long, b long, ra long, rb long, agree long").groupBy("a", "b").agg(
        F.min("ra").alias("ra"), F.min("rb").alias("rb"), F.count("*").alias("trees"), F.sum("agree").alias("agree"))
    pairs = pairs if every else pairs.where(likely(F.col("trees"), F.col("agree"), percent))
    return pairs.select("a", "b", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"),
                        (F.col("agree") / F.col("trees")).alias("score"))


def pictured(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pictures of the members' sets; none where an id has several texts."""
    seen = sets.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(pictures, "id long, picture binary")
    return seen.groupBy("id").agg(F.when(F.min("picture") == F.max("picture"), F.max("picture")).alias("picture"))


def count_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (heads, root, n) to members and shingles by head and component, added up a few batches at a time."""
    def counted(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        head, root, rows, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((root, head))
        head, root, rows, n = (c[order] for c in (head, root, rows, n))
        begin = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (root[1:] != root[:-1]))[: len(head)])
        sums = [np.add.reduceat(c, begin) if len(begin) else c for c in (rows, n)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (head[begin], root[begin], *sums)], ["head", "root", "rows", "n"])

    parts, held = [], 0
    for batch in batches:
        size = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
        each = lambda k, size=size, batch=batch: np.repeat(batch.column(k).to_numpy(), size)
        parts.append((batch.column(0).flatten().to_numpy(), each(1), np.ones(size.sum(), np.int64), each(2)))
        held += int(size.sum())
        if held > 4_000_000:
            yield counted(parts)
            parts, held = [], 0
    if parts:
        yield counted(parts)


def beyond(cut: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of different components (ra, rb) that share a head that was cut, as far as sizes and pictures allow; without
    ``every`` the likeliest ones. Members outside a head's largest component meet all its members, in blocks: tasks are as
    large as two blocks however large the head is."""
    # Most heads hold one component by now. To find the others each member meets its component once, with all its heads, and
    # heads are counted by component where the members are; only members of heads that are left are looked at one by one.
    once = cut.groupBy("id").agg(F.max("n").alias("n"), F.collect_set("head").alias("heads"))
    once = once.join(roots.withColumnRenamed("node", "id"), "id", "left").select("heads", F.coalesce("root", "id").alias("root"), "n")
    held = once.mapInArrow(count_roots, "head long, root long, rows long, n long").groupBy("head", "root").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n")).groupBy("head").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("total"), F.max_by(F.struct("root", "rows", "n"), F.struct("rows", "root")).alias("m"),
        F.count("*").alias("roots")).where("roots > 1")
    # a picture has up to half a byte for each shingle
    parts = lambda rows, n: F.ceil(F.greatest(rows / FACE, n / (2 * FACE_BYTES))).cast("int")
    held = stored(held.select("head", F.col("m.root").alias("main"), parts(F.col("rows"), F.col("total")).alias("blocks"),
                              parts(F.col("rows") - F.col("m.rows"), F.col("total") - F.col("m.n")).alias("others")), "split-heads")
    open_ = cut.join(held, "head").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = stored(open_, "open")
    open_ = open_.join(pictured(open_, sets), "id")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = open_.where("root <> main").select("head", own_part("others").alias("other"), every_part("blocks").alias("block"), "id", "n", "root", "picture")
    right = open_.select("head", every_part("others").alias("other"), own_part("blocks").alias("block"), "id", "n", "root", "main", "picture")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table
    by = ["head", "other", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(facing(percent, every), "a long, b long, ra long, rb long, score double")


def likely(trees: Column, agree: Column, percent: int) -> Column:
    """Whether the agreement over all shared trees is within SIGMAS of what a pair at the threshold shows. Tails overlap
    after some ten trees, so more of them do not count as more evidence. The spread is larger than this assumes, so it only
    says which pairs to try first."""
    seen = F.least(trees, F.lit(VALUES // TAIL)) * TAIL
    share = percent / 100
    return agree / (trees * TAIL) >= share - SIGMAS * (share * (1 - share)) ** 0.5 / F.sqrt(seen)


def labelled(signed: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Components of classes, handed to all their rows; classes with very many rows are dealt out."""
    total = signed.count()
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "rows", F.coalesce("root", "rep").alias("root"))
    rows = join_counted(signed.select("id", "n", "digest"), named, "digest", "rows", total, F.col("id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                       (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
