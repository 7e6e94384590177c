"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash of the document. A source that is to give
q times its size gives all blocks floor(q) times and, for the rest, the first blocks of a seeded
permutation; around the block that crosses the target, up to ZONE documents to either side form a zone in which documents
are taken one by one, in seeded order, as long as they fit, and some are exchanged where that brings the sum
nearer. So a source misses its target by less than its smallest documents. The drawn
blocks are counted for each source, and these exact quotas are split down a binary tree over the
output shards: at each node the left half receives a multivariate-hypergeometric share of the
blocks and the right half the remainder. A shard therefore holds a disjoint part of the drawn
blocks, with source counts as if it had been dealt at random without replacement. Within a shard
the documents are put in a seeded order.

Only the quotas (sources times shards numbers) are worked out on the driver; the weights name
every source, so that table is as small as what the caller states.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import WORD, stored

BLOCK_ROWS = 1024
LEAST_BLOCKS = 64
PART_WORDS = 1 << 24
"""Words in a part of a shard, some 100 MB of text."""
ZONE = 1024
"""Documents before and after the block that crosses the target that are chosen one by one."""
STARTS, ROUNDS = 64, 64
"""Orders that are tried in a zone, and exchanges in each, at most; both only bring the sum nearer."""
CAP = 3.0
BROADCAST_BLOCKS = 1 << 18
"""Drawn blocks that are sent to every task, a few dozen bytes each; the rows then stay where they are."""


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its source's size; what a capped
    source leaves goes to the others by weight, again and again until none is above."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    rest = float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns). Row sums are the quotas exactly, column
    sums differ by at most one."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())
    room = np.array([total * (s + 1) // shards - total * s // shards for s in range(shards)])
    rng = np.random.Generator(np.random.PCG64(seed))

    def split(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = own
            return
        mid = (lo + hi) // 2
        need, rest, left = int(room[lo:mid].sum()), int(own.sum()), np.zeros_like(own)
        for i, n in enumerate(own.tolist()):  # one draw without replacement, source after source
            rest -= n
            left[i] = draw(rng, n, rest, need)
            need -= int(left[i])
        split(lo, mid, left)
        split(mid, hi, own - left)

    if len(quotas):
        split(0, shards, np.asarray(quotas, np.int64))
    return out


def draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` draws are good. NumPy's generator is limited to 10**9; above, the law itself is summed
    around its mode, as far as it differs from nothing in double precision."""
    if not good or not taken:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, taken))
    n = good + bad
    mode = (taken + 1) * (good + 1) // (n + 2)
    spread = (taken * (good / n) * (bad / n) * ((n - taken) / max(n - 1, 1))) ** 0.5
    reach = int(40 * spread) + 50
    k = np.arange(max(0, taken - bad, mode - reach), min(good, taken, mode + reach) + 1)
    up, left = k[:-1].astype(float), float(bad - taken)
    step = np.log(good - up) + np.log(taken - up) - np.log(up + 1) - np.log(left + up + 1)
    law = np.concatenate([[0.0], np.cumsum(step)])
    law = np.cumsum(np.exp(law - law.max()))
    return int(k[min(np.searchsorted(law, rng.random() * law[-1], side="right"), len(k) - 1)])


def fill(sizes: np.ndarray, room: float) -> np.ndarray:
    """Which documents to take so that their sizes come near ``room``: from the given order, and from further
    shuffled ones until the sum is as near as whole words allow, the best choice."""
    best, off = np.zeros(len(sizes), bool), abs(room)
    for turn in range(STARTS):
        order = np.random.Generator(np.random.PCG64(turn)).permutation(len(sizes)) if turn else np.arange(len(sizes))
        taken = filled(sizes[order], room)
        missed = abs(sizes[order[taken]].sum() - room)
        if missed < off:
            best, off = np.zeros(len(sizes), bool), missed
            best[order[taken]] = True
        if off <= 0.5:
            break
    return best


def filled(sizes: np.ndarray, room: float) -> np.ndarray:
    """One choice, in the given order: each document that still fits, then, as long as it brings the sum nearer, one more,
    one less, or one for another."""
    taken, left = np.zeros(len(sizes), bool), room
    for i, size in enumerate(sizes.tolist()):
        if size <= left:
            taken[i], left = True, left - size
    for _ in range(ROUNDS):
        out, own = np.append(np.flatnonzero(~taken), -1), np.append(np.flatnonzero(taken), -1)  # -1: none
        weight = lambda at: np.where(at >= 0, sizes[at], 0)
        own = own[np.argsort(weight(own), kind="stable")]
        at = np.searchsorted(weight(own), weight(out) - left)
        pairs = [(out, own[np.clip(at + d, 0, len(own) - 1)]) for d in (-1, 0)]
        add, drop = (np.concatenate(c) for c in zip(*pairs))
        after = np.abs(left - weight(add) + weight(drop))
        best = int(np.argmin(after))
        if after[best] >= abs(left):
            break
        left += weight(drop[best]) - weight(add[best])
        for i, value in ((add[best], True), (drop[best], False)):
            if i >= 0:
                taken[i] = value
    return taken


def fill_zone(group: pa.Table) -> pa.Table:
    """The zone of one source to the rows that are taken from it."""
    group = group.combine_chunks().sort_by([("order", "ascending"), ("row", "ascending")])
    taken = fill(group.column("size").to_numpy(), group.column("room")[0].as_py()) if group.num_rows else np.zeros(0, bool)
    return pa.table({"_row": group.column("row").filter(pa.array(taken))})


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, 1, ... over the sources in code-point order, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s])
    ordered += [None] * (None in sources)
    return {s: float(1 + i % 3) for i, s in enumerate(ordered)}


def mix(docs: DataFrame, weights: Callable[[list], dict] | dict = ranked_weights, shards: int = 16, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
        share: float = 1.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken and ``draws``, the copies
    that the mix takes as array<struct<shard, order>>; columns in ``keep`` are carried along.

    Explode ``draws`` and write by (shard, order) for the mix itself (``mixture``). Null texts have
    size 0, null sources are one source, after the others. A source without words gives nothing. Each row counts by
    itself, also where rows repeat or have no id. Empty input: no rows.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    base = stored(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                              word_count(F.col(text_col)).alias("_size"), key.alias("_key"), F.monotonically_increasing_id().alias("_row"),
                              *[F.col(c).alias(f"_keep_{c}") for c in keep]), "mix-sizes")
    sums = base.groupBy("_source").agg(F.sum("_size").alias("words"), F.count("*").alias("rows")).collect()
    sums = sorted(sums, key=lambda r: (r["_source"] is None, [ord(c) for c in r["_source"] or ""]))
    by = weights if isinstance(weights, dict) else weights([r["_source"] for r in sums])
    sizes = [r["words"] for r in sums]
    wanted = targets(sizes, [float(by.get(r["_source"], 0)) for r in sums], share * sum(sizes))
    blocks = [max(LEAST_BLOCKS, -(-r["rows"] // BLOCK_ROWS)) for r in sums]
    plan = spark.createDataFrame(
        [(r["_source"], i, r["words"], float(w), b, int(w // r["words"]) if r["words"] else 0)
         for i, (r, w, b) in enumerate(zip(sums, wanted, blocks))],
        "_source string, _nr int, source_size long, target double, _blocks int, _full int")
    rows = base.join(F.broadcast(plan), base["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])
    rows = rows.withColumn("_block", F.pmod(F.col("_key"), F.col("_blocks")).cast("int"))

    # The permuted blocks of each source, with the words and rows before each one; those of the zone share its room.
    held = rows.groupBy("_nr", "_block", "source_size", "target", "_full").agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows"))
    held = held.withColumn("_order", F.xxhash64(F.lit(seed + 1), "_nr", "_block"))
    along = Window.partitionBy("_nr").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("target") - F.col("_full") * F.col("source_size")
    held = held.withColumn("_room", rest - (F.sum("_words").over(along) - F.col("_words"))).withColumn("_past", F.sum("_rows").over(along) - F.col("_rows"))
    crossing = (F.col("_room") > 0) & (F.col("_room") < F.col("_words"))
    each = Window.partitionBy("_nr")
    held = held.withColumn("_cut", F.max(F.when(crossing, F.struct("_past", "_rows"))).over(each))
    zone = F.col("_past").between(F.col("_cut._past") - ZONE, F.col("_cut._past") + F.col("_cut._rows") + ZONE)
    held = held.withColumn("_part", F.when(zone, 1).when((F.col("_room") > 0) & ~crossing, 2).otherwise(0))
    held = held.withColumn("_zone_room", F.max(F.when(F.col("_part") == 1, F.col("_room"))).over(each))
    held = held.withColumn("_turns", F.col("_full") + (F.col("_part") > 0).cast("int"))
    held = stored(held.select("_nr", "_block", F.col("_zone_room").alias("_room"), "_part", "_turns", "_order"), "mix-blocks")
    drawn = held.groupBy("_nr").agg(F.sum("_turns").alias("n"), F.count_if(F.col("_turns") > 0).alias("blocks")).collect()
    quota = {r["_nr"]: r["n"] for r in drawn}
    dealt = split_quotas(np.array([quota.get(i, 0) for i in range(len(sums))], np.int64), shards, seed)
    ends = np.cumsum(dealt, axis=1)
    limits = spark.createDataFrame([(i, ends[i].tolist()) for i in range(len(sums))], "_nr int, _ends array<long>")

    # The n-th drawn block of a source goes to the shard whose quota covers n.
    turns = held.where("_turns > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    first = F.row_number().over(Window.partitionBy("_nr").orderBy(
        F.xxhash64(F.lit(seed + 2), "_block", "_turn"), "_block", "_turn")) - 1
    turns = turns.withColumn("_n", first).join(F.broadcast(limits), "_nr")
    turns = turns.withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= F.col("_n"))))
    placed = turns.groupBy("_nr", "_block").agg(
        F.min("_room").alias("_room"), F.min("_part").alias("_part"), F.min("_turns").alias("_turns"),
        F.array_sort(F.collect_list(F.struct("_turn", "_shard"))).alias("_places"))
    # One row for some BLOCK_ROWS documents; without the hint Spark, which cannot tell, shuffles all kept columns twice.
    if sum(r["blocks"] for r in drawn) <= BROADCAST_BLOCKS:
        placed = F.broadcast(placed)

    # The zone is filled by sizes alone; what is taken comes back by row.
    rows = rows.join(placed, ["_nr", "_block"], "left")
    zone = rows.where("_part = 1").select("_nr", F.col("_row").alias("row"), F.xxhash64(F.lit(seed + 3), "_key").alias("order"),
                                          F.col("_size").alias("size"), F.col("_room").alias("room"))
    filled = zone.groupBy("_nr").applyInArrow(fill_zone, "_row long").withColumn("_filled", F.lit(1))
    whole = rows.where("coalesce(_part, 0) <> 1").withColumn("_copies", F.coalesce(F.col("_turns"), F.lit(0)))
    some = rows.where("_part = 1").join(filled, "_row", "left")
    some = some.withColumn("_copies", F.col("_turns") - 1 + F.coalesce(F.col("_filled"), F.lit(0))).drop("_filled")
    done = whole.unionByName(some)
    draws = F.transform(
        F.slice(F.coalesce(F.col("_places"), F.array().cast("array<struct<_turn:int,_shard:int>>")), 1, F.greatest("_copies", F.lit(0))),
        lambda p: F.struct(p["_shard"].alias("shard"),
                           F.xxhash64(F.lit(seed + 4), "_key", p["_turn"]).alias("order")))
    return done.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"),
                       "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"),
                       draws.alias("draws"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def mixture(mixed: DataFrame, shards: int = 16, part_words: int = PART_WORDS) -> DataFrame:
    """The mix: a row for each copy, dealt by shard and within it by the leading bits of the seeded order, so every partition is
    a consecutive part of one shard and each drawn text is moved once. Hot sources are no hot keys here, as every
    shard has its quota of blocks; a shard has as many parts as its words need."""
    words = mixed.agg(F.sum("taken").alias("words")).first()["words"] or 0
    parts = max(1, -(-words // (shards * part_words)))
    rows = mixed.withColumn("_draw", F.explode("draws")).drop("draws")
    rows = rows.select("*", F.col("_draw.shard").alias("shard"), F.col("_draw.order").alias("shard_order")).drop("_draw")
    rows = rows.repartitionById(shards * parts, (F.col("shard") * parts + _part_of(F.col("shard_order"), parts)).cast("int"))
    return rows.sortWithinPartitions("shard", "shard_order")


def _part_of(order: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges of signed 64-bit numbers a number lies in."""
    high = F.shiftright(order, 32) + F.lit(1 << 31)
    return F.shiftright(high * F.lit(parts), 32)
