"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Groups (equal texts) stay together. The largest groups, each above 1/ATOMS of all bytes and
therefore fewer than ATOMS, enter the differencing one by one; all smaller groups are bundled by a
hash of the text into ATOMS bundles. So the differencing sees at most 2 * ATOMS numbers whatever
the input, and needs no more than those on the driver. It starts with one partial partition for
each number, repeatedly takes the two with the largest spread, adds them in opposite order, largest
sum onto smallest, and ends with a single partition of near-equal sums.

Documents then look up their bundle or group in two bounded tables; they are not shuffled for
that. Positions within a shard are numbered in parts, so no shard has to fit into one task.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import stored

ATOMS = 16384
OVERHEAD = 16
PARTS = 512


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each number. Partial partitions are kept as sorted sums with, for each sum, the
    root of a tree of numbers, so joining two of them costs one pass over the shards."""
    n = len(sizes)
    if not n or shards == 1:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    roots: dict[int, np.ndarray] = {}
    left: list[int] = []
    right: list[int] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums[i] = np.zeros(shards, np.int64)
        sums[i][0] = size
        roots[i] = np.full(shards, -1, np.int64)
        roots[i][0] = i
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        root = roots[a].copy()
        for k, other in enumerate(roots[b][::-1].tolist()):
            if other >= 0:
                if root[k] >= 0:
                    left.append(int(root[k]))
                    right.append(other)
                    root[k] = n + len(left) - 1
                else:
                    root[k] = other
        order = np.argsort(-total, kind="stable")
        sums[a], roots[a] = total[order], root[order]
        del sums[b], roots[b]
        heapq.heappush(heap, (int(sums[a][-1] - sums[a][0]), a))
    out = np.zeros(n, np.int64)
    stack = [(int(root), k) for k, root in enumerate(roots[heap[0][1]]) if root >= 0]
    while stack:
        node, k = stack.pop()
        if node < n:
            out[node] = k
        else:
            stack += [(left[node - n], k), (right[node - n], k)]
    return out


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    atoms: int = ATOMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, size (UTF-8 bytes and OVERHEAD), text_crc32, law "bytes", shard, slot.

    Rows with equal texts, empty ones too, share a shard; a null text is a group of its own with size
    OVERHEAD and a null checksum. Slots of a shard run from 0 without gaps, also over null and repeated
    ids. If one group is larger than a fair shard, its shard holds little else and the others are
    even among themselves. Empty input: no rows. ``keep`` names columns to carry along.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.xxhash64(text_col, F.lit(1)) , F.lit(0))
    group = F.when(F.col(text_col).isNull(), F.xxhash64(F.col(id_col).cast("string"), F.lit(2))).otherwise(own)
    base = docs.select(
        F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(F.col(text_col).cast("binary")).alias("_crc"), group.alias("_group"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = stored(base, "shard-sizes")
    total = base.agg(F.sum("_size").alias("n")).first()["n"] or 0
    groups = stored(base.groupBy("_group").agg(F.sum("_size").alias("_bytes")), "shard-groups")
    bundle = F.pmod(F.xxhash64("_group"), F.lit(atoms)).cast("int")
    large = groups.where(F.col("_bytes") * atoms > total).select("_group", "_bytes").toPandas()
    large = large.sort_values(["_bytes", "_group"], ascending=[False, True])
    small = groups.where(F.col("_bytes") * atoms <= total).groupBy(bundle.alias("_bundle")).agg(
        F.sum("_bytes").alias("_bytes")).toPandas().sort_values("_bundle")
    shard = difference(np.concatenate([large["_bytes"], small["_bytes"]]).astype(np.int64), shards)
    large = large.assign(_large=shard[: len(large)].astype("int32"))[["_group", "_large"]]
    small = small.assign(_small=shard[len(large):].astype("int32"))[["_bundle", "_small"]]
    large = spark.createDataFrame(list(map(tuple, large.values.tolist())), "_group long, _large int")
    small = spark.createDataFrame(list(map(tuple, small.values.tolist())), "_bundle int, _small int")
    part = F.pmod(F.xxhash64(F.col("_id").cast("string"), "_crc", F.lit(3)), F.lit(PARTS)).cast("int")
    placed = (base.withColumn("_bundle", bundle).join(F.broadcast(large), "_group", "left")
              .join(F.broadcast(small), "_bundle", "left")
              .withColumn("_shard", F.coalesce("_large", "_small")).withColumn("_part", part))

    # Slots: parts of a shard are numbered on their own and start behind the parts before them.
    held = placed.groupBy("_shard", "_part").agg(F.count("*").alias("_rows"))
    start = F.sum("_rows").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_rows")
    held = held.select("_shard", "_part", start.alias("_start"))
    within = Window.partitionBy("_shard", "_part").orderBy("_id", "_crc", "_size")
    placed = placed.withColumn("_within", F.row_number().over(within) - 1)
    placed = placed.join(F.broadcast(held), ["_shard", "_part"])
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_start") + F.col("_within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
