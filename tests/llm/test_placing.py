"""Mixing and sharding: laws, exactness, odd rows."""

import random
import zlib
from itertools import combinations
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from slotframe.llm import mixing, sharding


def collection(seed, n=3000):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", rng.choice(["hot"] * 5 + ["a", "b", "é", "", None])) for i in range(n)]


def test_targets_are_shared_and_capped():
    got = mixing.targets([100, 10, 890], [1, 2, 3], 1000)
    assert got[1] == 30 and abs(sum(got) - 1000) < 1e-9 and abs(got[2] / got[0] - 3) < 1e-9
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 5], [1, 1], 5) == [0, 5]
    assert sum(mixing.targets([1, 1], [1, 1], 100)) == 6


def test_quotas_split_exactly():
    quotas = np.array([10, 0, 333, 7, 1])
    dealt = mixing.split_quotas(quotas, 12, 5)
    assert (dealt.sum(1) == quotas).all() and dealt.sum(0).max() - dealt.sum(0).min() <= 1 and (dealt >= 0).all()
    assert (dealt == mixing.split_quotas(quotas, 12, 5)).all()
    means = np.mean([mixing.split_quotas(np.array([40, 60]), 4, s) for s in range(400)], axis=0)
    assert np.abs(means - [[10] * 4, [15] * 4]).max() < 0.5
    assert 0 <= mixing.draw(np.random.default_rng(1), 10**12, 10**11, 10**10) <= 10**10


def test_mix_holds_its_targets(make_docs):
    rows = collection(1)
    mixed = mixing.mix(make_docs(rows), shards=7).collect()
    words = Counter()
    for _, text, _, source in rows:
        words[source] += len(text.split())
    ordered = sorted([s for s in words if s is not None]) + [None]
    wanted = dict(zip(ordered, mixing.targets([words[s] for s in ordered], [1 + i % 3 for i in range(len(ordered))], sum(words.values()))))
    taken, largest = Counter(), defaultdict(int)
    for r in mixed:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r["size"] * len(r.draws) <= 3 * r["size"] and abs(r.target - wanted[r.source]) < 1e-6
        assert r.source_size == words[r.source]
    assert len(mixed) == len(rows)
    smallest = {s: min(r["size"] for r in mixed if r.source == s and r["size"]) for s in ordered}
    for s in ordered:
        assert abs(taken[s] - wanted[s]) <= smallest[s]
    again = mixing.mix(make_docs(list(reversed(rows))).repartition(5), shards=7).collect()
    assert {(r.doc_id, tuple(r.draws)) for r in again} == {(r.doc_id, tuple(r.draws)) for r in mixed}
    out = mixing.mixture(mixing.mix(make_docs(rows), shards=7), 7).collect()
    assert len(out) == sum(len(r.draws) for r in mixed) and {r.shard for r in out} == set(range(7))
    assert [(r.shard, r.shard_order) for r in out] == sorted((r.shard, r.shard_order) for r in out)


def test_a_long_document_does_not_spoil_the_target(make_docs):
    """Sources of few documents, one of which is longer than all that is wanted of it."""
    rng = random.Random(9)
    rows = []
    for source in "abcdef":
        for size in [rng.randrange(20, 400) for _ in range(40)] + [4000]:
            rows.append((len(rows), " ".join(f"w{rng.randrange(999)}" for _ in range(size)), "en", source))
    mixed = mixing.mix(make_docs(rows)).collect()
    taken, wanted = Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        wanted[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - w) <= 0.01 * w for s, w in wanted.items())


def test_given_tables_meet_their_targets(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        sums = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
        assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in sums)


def test_fill_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 60, rng.integers(1, 9))
        room = float(rng.uniform(0, sizes.sum()))
        taken = mixing.fill(sizes, room)
        sums = [sum(c) for k in range(len(sizes) + 1) for c in combinations(sizes.tolist(), k)]
        nearest = min(abs(s - room) for s in sums)
        assert abs(sizes[taken].sum() - room) <= max(nearest, 1)
    long = rng.integers(1, 5000, 600)
    assert abs(long[mixing.fill(long, 123_456.0)].sum() - 123_456) <= 2


def test_large_draws_follow_the_law():
    """Above the generator's limit: mean and spread of the hypergeometric law, and its bounds."""
    rng = np.random.default_rng(3)
    good, bad, taken = 3 * 10**9, 7 * 10**9, 10**6
    seen = np.array([mixing.draw(rng, good, bad, taken) for _ in range(300)])
    spread = (taken * 0.3 * 0.7) ** 0.5
    assert abs(seen.mean() - 300_000) < 4 * spread / 300 ** 0.5 and 0.85 < seen.std() / spread < 1.15
    assert mixing.draw(rng, 10**10, 3, 10**10 + 3) == 10**10 and mixing.draw(rng, 10**10, 3, 1) in (0, 1)
    assert 10**10 - 3 <= mixing.draw(rng, 10**10, 3, 10**10) <= 10**10


def test_rows_without_an_id_count_one_by_one(make_docs):
    rows = [(None, "one two three four five six seven eight nine ten", "en", "a")] * 30 + [
        (i, " ".join(["word"] * 11), "en", "b") for i in range(30)]
    taken, target = Counter(), {}
    for r in mixing.mix(make_docs(rows)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 6 for s, t in target.items())


def test_files_of_the_mix_hold_one_shard_each(spark, make_docs, tmp_path):
    rows = [(i, f"{i} " * (1 + i % 50), "en", "abc"[i % 3]) for i in range(900)]
    mixed = mixing.mix(make_docs(rows), shards=5)
    mixing.mixture(mixed, 5, part_words=1000).write.parquet(str(tmp_path / "mix"))
    files = spark.read.parquet(str(tmp_path / "mix")).withColumn("file", F.input_file_name()).groupBy("file").agg(
        F.collect_set("shard").alias("shards"), F.min("shard_order").alias("lo"), F.max("shard_order").alias("hi")).collect()
    assert len(files) > 10 and all(len(r.shards) == 1 for r in files) and {r.shards[0] for r in files} == set(range(5))
    for shard in range(5):
        own = sorted((r.lo, r.hi) for r in files if r.shards[0] == shard)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


def test_mix_odd_rows(odd_docs, make_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == 13 and all(r.taken == 0 for r in got if r["size"] == 0) and {r["size"] for r in got if r.doc_id in (2, 3, 4, 9)} == {0}
    assert mixing.mix(make_docs([])).collect() == []


def test_differencing_is_tight():
    rng = np.random.default_rng(2)
    sizes = (rng.lognormal(8, 1.3, 3000)).astype(np.int64)
    sums = np.bincount(sharding.difference(sizes, 40), sizes, 40)
    assert sums.max() - sums.min() <= 0.001 * sums.mean()
    two = np.bincount(sharding.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(two) == [14, 16]  # the well-known case in which differencing is one off
    assert len(sharding.difference(np.zeros(0, np.int64), 4)) == 0 and sharding.difference(np.array([5, 6]), 1).tolist() == [0, 0]


def check_shards(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    slots, by_text, sums = defaultdict(list), {}, Counter()
    texts = defaultdict(set)
    for i, text, *_ in rows:
        texts[i].add(text)
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        if len(texts[r.doc_id]) == 1 and (text := next(iter(texts[r.doc_id]))) is not None:
            assert by_text.setdefault(text, r.shard) == r.shard
            assert r["size"] == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    return [sums[s] for s in range(shards)]


def test_shards(make_docs):
    rows = [(i, t + str(i % 1500), *r) for i, t, *r in collection(3)]
    sums = check_shards(rows, sharding.shard_documents(make_docs(rows), 10).collect(), 10)
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 10


def test_one_large_group_keeps_together(make_docs):
    rows = [(i, "the same text for a third of all rows" if i % 3 == 0 else f"text {i}", "en", "a") for i in range(600)]
    sums = check_shards(rows, sharding.shard_documents(make_docs(rows), 8, atoms=64).collect(), 8)
    rest = sorted(sums)[:-1]
    assert max(rest) - min(rest) <= 0.1 * sum(rest) / 7


def test_shards_odd_rows(odd_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sharding.shard_documents(odd_docs, 3).collect()
    check_shards(rows, got, 3)
    assert {r["size"] for r in got if r.doc_id == 2} == {16} and [r.text_crc32 for r in got if r.doc_id == 2] == [None]
    assert sharding.shard_documents(make_docs([]), 3).collect() == []


def test_no_texts_in_the_driver(make_docs):
    """What reaches the driver is bounded by the atoms, not by the rows."""
    docs = make_docs([(i, f"text {i}", "en", "a") for i in range(500)])
    assert sharding.shard_documents(docs, 4, atoms=16).agg(F.countDistinct("shard")).first()[0] == 4


def test_the_mix_moves_kept_columns_only_for_the_zone(spark):
    """Drawn blocks come to the rows; when they were joined by a shuffle, every kept text was written to disk twice on the way."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id")).alias("text"),
                                    F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("x"), 50).alias("more"))
    mixed = mixing.mix(docs, keep=("more",))
    plan = mixed._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "SortMergeJoin [_nr" in line or "ShuffledHashJoin [_nr" in line]
    assert mixed.count() == 3000
