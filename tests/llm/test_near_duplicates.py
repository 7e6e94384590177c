"""The forest and the line join against plain Python."""

import random

import pytest

import numpy as np
import pyarrow as pa

from slotframe.llm import linededup, minhash
from slotframe.llm import shingles as hashing
from slotframe.llm.components import components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b, percent=80):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def brute_components(rows, width):
    sets, root = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if alike(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def family(seed, n=150):
    """Copies, copies with some words changed, and unrelated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases)) if i % 3 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 5), (3, 2)])
def test_forest_equals_brute_force(make_docs, seed, width):
    rows = family(seed)
    want, sizes = brute_components(rows, width)
    got = minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows]), width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_forest_in_one_dense_region(make_docs, monkeypatch):
    """More variants of one text than a region holds, an outlier, and small regions."""
    monkeypatch.setattr(minhash, "REGION", 8)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(120)] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(text)))
    want, _ = brute_components(rows, 2)
    got = minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows]), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("seed", [2, 5])
def test_forest_links_an_outlier_to_a_large_family(make_docs, seed):
    """One long body, each copy with words of its own, and a text at 0.83 that has none of the copies in its part of any cut head."""
    body = [f"b{seed}-{i}" for i in range(1500)]
    rows = [(i, " ".join(body + [f"f{seed}-{i}-{k}" for k in range(5)])) for i in range(1000)]
    rows.append((1000, " ".join(body[:1362] + [f"o{seed}-{i}" for i in range(138)])))
    assert alike(shingles(rows[0][1], 2), shingles(rows[-1][1], 2), 82)
    got = minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows]), width=2).collect()
    assert {r.doc_id for r in got} == set(range(1001)) and {r.component_id for r in got} == {0}


def test_forest_bounds_blocks_of_a_cut_head(make_docs, monkeypatch):
    """Small regions and blocks, families that do not hang together under common heads, and rows that share an id."""
    monkeypatch.setattr(minhash, "REGION", 4)
    monkeypatch.setattr(minhash, "FACE", 8)
    rng = random.Random(9)
    base, rows = [f"v{i}" for i in range(200)], []
    for i in range(120):
        text = list(base)
        for k in range(i % 4):  # up to three blocks of 15 words differ, and some words
            text[50 * k + 5: 50 * k + 20] = [f"y{i % 12}-{k}-{j}" for j in range(15)]
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(200)] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(text)))
    want, _ = brute_components(rows, 2)
    assert len(set(want.values())) > 3
    got = minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in [*rows, rows[7]]]), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == 121


def test_forest_tries_pairs_whose_tails_agree_little(spark):
    """Two alike sets in three common regions with 5 of 12 tail values equal: the last pass has them, whatever the tails say."""
    tails = [bytes(range(minhash.TAIL)), bytes([*range(5), *[99] * (minhash.TAIL - 5)])]
    members = spark.createDataFrame([(r, bytearray(tails[i]), i, 50) for r in (11, 12, 13) for i in (0, 1)], "region long, tail binary, id long, n long")
    big = [(k * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(1, 53)]
    sets = spark.createDataFrame([(0, sorted(big[:50])), (1, sorted(big[2:]))], "id long, shingles array<long>")
    pairs = minhash.apart(members, spark.createDataFrame([], "node long, root long"), sets, 80)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]


def test_forest_odd_rows(odd_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd_docs).collect()]
    assert len(got) == 13
    assert got.count((1, 3, 1, True)) == 2
    assert (None, 3, None, True) in got and (None, 0, None, True) in got
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert {(g[2], g[3]) for g in got if g[0] in (5, 6)} == {(5, True), (5, False)}


def test_forest_empty(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, 200 + i) for i in range(300)]
    rows = components(spark.createDataFrame([*path, *hub, (3, 3), (160, 161), (9, 7)], "a long, b long")).collect()
    roots = {r.node: r.root for r in rows}
    assert len(rows) == len(roots)
    assert all(roots[i] == 100 for i in range(100, 162)) and all(roots[200 + i] == 7 for i in range(300)) and roots[9] == 7


def brute_lines(rows, percent=80):
    seen, out = [], {}
    for i, text in sorted(rows):
        out[i] = []
        for k, line in enumerate(text.split("\n") if text is not None else []):
            words = set(line.encode().lower().split())
            if words and any(alike(words, s, percent) for s in seen):
                out[i].append(k)
            seen.append(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(make_docs, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.02))}" for _ in range(600)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 40))] for _ in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        rows.append((i, "\n".join(lines)))
    found = linededup.line_matches(make_docs([(i, t, "en", "s") for i, t in rows]))
    assert {r.doc_id: r.removed for r in found.collect()} == brute_lines(rows)


@pytest.mark.parametrize("block", [3, 8])
def test_lines_under_busy_words(make_docs, monkeypatch, block):
    """Words that many lines share as their rarest ones, in lines of many lengths: blocks lose no match and add none."""
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for i in range(70):
        lines = [f"id {rng.randrange(40)} status {rng.choice('ab')} done"]
        body = [f"t{k}" for k in range(rng.choice((6, 7, 8, 9, 10, 12, 30)))]
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            body[rng.randrange(len(body))] = f"z{rng.randrange(60)}"
        lines.append(" ".join(body))
        rows.append((i, "\n".join(lines)))
    found = linededup.line_matches(make_docs([(i, t, "en", "s") for i, t in rows]))
    assert {r.doc_id: r.removed for r in found.collect()} == brute_lines(rows)


def test_faces_hold_each_pair_that_filters_allow_once(spark):
    """Two classes of a busy word meet under one key if sizes and places allow it; classes that cannot match share few keys."""
    rng, percent = random.Random(4), 80
    rows = [(5, d, 0, n << 32 | rng.randrange(n - (n * percent + 99) // 100 + 1), 0) for d in range(300) for n in [rng.choice((5, 5, 5, 6, 20, 22, 40))]]
    rows += [(6, d, 0, 5 << 32 | 1, 0) for d in range(400)]
    postings = spark.createDataFrame(rows, linededup.POSTING)
    several = postings.groupBy("token").count().withColumnRenamed("count", "rows")
    old, linededup.BLOCK = linededup.BLOCK, 32
    try:
        got = linededup.keyed(postings, several, percent).collect()
    finally:
        linededup.BLOCK = old
    size, under = {r[1]: r[3] for r in rows if r[0] == 5}, {}
    for r in got:
        under.setdefault(r.key, []).append((r.doc, r.side))
    met = {}
    for held in under.values():
        for k, (a, x) in enumerate(held):
            for b, y in held[k + 1:]:
                if x != y or x == linededup.BOTH:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    for a in range(300):
        for b in range(a + 1, 300):
            (n, p), (m, q) = ((size[x] >> 32, size[x] & 0xFFFFFFFF) for x in (a, b))
            if min(n, m) * 100 >= max(n, m) * percent and min(n - p, m - q) >= -(-percent * (n + m) // (100 + percent)):
                assert met[a, b] == 1
    # five words with the shared one in second place: never alike enough by this word alone
    assert not any(a >= 300 or b >= 300 for a, b in met)
    assert max(map(len, under.values())) <= 2 * 64


@pytest.mark.parametrize("share", [1, 16])
def test_lines_of_busy_words_in_small_parts(make_docs, monkeypatch, share):
    """Many parts, and busy words known before postings are dealt out or only where they meet: no match is lost, none added."""
    for name, value in (("BLOCK", 3), ("PART", 16), ("SHARE", share)):
        monkeypatch.setattr(linededup, name, value)
    rng = random.Random(share)
    rows = []
    for i in range(90):
        body = [f"t{k}" for k in range(rng.choice((6, 9, 10, 12)))]
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            body[rng.randrange(len(body))] = f"z{rng.randrange(60)}"
        rows.append((i, f"id {rng.randrange(50)} status {rng.choice('ab')} done\n" + " ".join(body)))
    found = linededup.line_matches(make_docs([(i, t, "en", "s") for i, t in rows]))
    assert {r.doc_id: r.removed for r in found.collect()} == brute_lines(rows)


def test_long_lines_do_not_meet_by_chance():
    """Long lines with a word in common: none but the alike ones meet, which 64 cells could not tell apart."""
    rng = random.Random(6)
    lines = [["shared", *[f"w{rng.randrange(10**6)}" for _ in range(159)]] for _ in range(300)]
    lines += [[*line[:150], *[f"y{i}-{k}" for k in range(10)]] for i, line in enumerate(lines[:40])]
    docs = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(lines)), pa.int64()), "text": [" ".join(x) for x in lines]})
    rows = pa.Table.from_batches(list(linededup.describe(np.zeros(linededup.BUCKETS, np.int64), 80)(iter([docs]))))
    n, doc = rows["n"].to_numpy().astype(np.int64), rows["doc"].to_numpy()
    order = np.argsort(n << 32, kind="stable")
    zero = np.zeros(len(n), np.int64)
    columns = [zero, doc[order], zero, n[order] << 32, rows["bits"].to_numpy()[order], zero + linededup.BOTH]
    pairs = [{(int(columns[1][a]), int(columns[1][b])) for x, y in linededup.meetings(c, 80) for a, b in zip(x, y)}
             for c in (columns, [*columns, rows["more"].to_numpy()[order]])]
    alike_ones = {(i, 300 + i) for i in range(40)}
    assert alike_ones <= pairs[1] <= pairs[0]
    assert len(pairs[1]) < 60 and len(pairs[0]) > 10 * len(pairs[1])


def test_texts_are_not_read_again_to_count_their_lines(spark, make_docs, tmp_path):
    """The last step takes the numbers of lines from the first one, also of texts without words and of nulls."""
    rows = [(1, "a b c\n\nx"), (2, "\n\n"), (3, None), (4, ""), (5, "x\nA b c\na b c\nx")]
    make_docs([(*r, "en", "s") for r in rows]).write.parquet(str(tmp_path / "docs"))
    found = linededup.line_matches(spark.read.parquet(str(tmp_path / "docs"))).select("doc_id", "n_lines", "removed")
    assert {r.doc_id: (r.n_lines, r.removed) for r in found.collect()} == {1: (3, []), 2: (3, []), 3: (0, []), 4: (1, []), 5: (4, [0, 1, 2, 3])}
    scans = [x for x in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan" in x]
    assert scans and not any("text#" in x for x in scans)


def test_first_line_of_a_class_within_one_text(make_docs):
    """Lines that one text has several times, before and after others have them: only the very first stays."""
    rows = [(7, "one two three\nsame same words\nOne two three"), (3, "q r s\nwords same\nsame words\nq r s"), (None, "s r q\nnew")]
    found = linededup.line_matches(make_docs([(*r, "en", "s") for r in rows]))
    assert {r.doc_id: r.removed for r in found.collect()} == {7: [1, 2], 3: [2, 3], None: [0]}


def test_pairs_that_places_rule_out_are_not_tried(monkeypatch):
    """Of 600 classes that share only their last prefix word, each two would share too few words: no pair is looked at."""
    tried, real = [], linededup.least_common
    monkeypatch.setattr(linededup, "least_common", lambda n, m, percent: tried.append(len(n)) or real(n, m, percent))
    rows, zero = 600, np.zeros(600, np.int64)
    size = np.full(rows, 50 << 32 | 10)
    columns = [zero, np.arange(rows), zero, size, zero, zero + linededup.BOTH]
    assert list(linededup.meetings(columns, 80)) == [] and sum(tried) <= 2 * rows
    columns[3] = size - 10
    assert sum(len(a) for a, _ in linededup.meetings(columns, 80)) == rows * (rows - 1) // 2


def test_words_have_one_hash_wherever_sums_begin(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abCd\u00e9", k=rng.choice((1, 3, 70)))) for _ in range(rng.randrange(9))).encode() for _ in range(60)]
    hashed, counts = hashing.word_hashes(texts)
    alone = [hashing.word_hashes([t]) for t in texts]
    assert counts.tolist() == [len(t.split()) for t in texts] == [int(c[0]) for _, c in alone]
    assert hashed.tolist() == [v for h, _ in alone for v in h.tolist()]
    for span in (1, 16):
        monkeypatch.setattr(hashing, "SPAN", span)
        assert hashing.word_hashes(texts)[0].tolist() == hashed.tolist()


def test_equal_values_stay_in_order():
    """With room for the places beside the values, and without."""
    rng = np.random.default_rng(3)
    for top in (5, 1 << 62):
        values = rng.choice(np.array([0, 1, top // 2, top]), 500)
        assert linededup.ordered(values).tolist() == np.argsort(values, kind="stable").tolist()
    assert linededup.ordered(np.zeros(0, np.int64)).tolist() == []


def test_lines_are_cut_out(make_docs):
    docs = make_docs([(1, "a b c\nkeep me\n", "en", "s"), (2, "x\nA B C\n\nA b c", "en", "s"), (None, "a b c\nnew", "en", "s"), (3, None, "en", "s")])
    got = linededup.remove_lines(docs, linededup.line_matches(docs)).collect()
    assert {r.doc_id: r.text for r in got} == {1: "a b c\nkeep me\n", 2: "x\n", None: "new", 3: None}
    assert len(got[0]) == len(docs.columns)


def test_rows_of_one_id_keep_their_own_lines(make_docs):
    """Rows without an id and rows that share one: a line goes only where it has an earlier match itself."""
    shared = "words that many rows have in common here"
    rows = [(None, f"{shared}\ntotally unique words stay here please {i} q{i} r{i} s{i}") for i in range(3)] + [
        (7, f"alpha{i} beta{i} gamma{i}\n{shared}") for i in range(3)] + [(9, "one two three")] * 3
    docs = make_docs([(*r, "en", "s") for r in rows])
    got = sorted((str(r.doc_id), r.text) for r in linededup.remove_lines(docs, linededup.line_matches(docs)).collect())
    unique = [("None", f"totally unique words stay here please {i} q{i} r{i} s{i}") for i in range(3)]
    sevens = [t for i, t in got if i == "7"]
    assert [g for g in got if g[0] == "None"] == unique
    assert sum(shared in t for t in sevens) == 1 and all(any(f"alpha{i} beta{i} gamma{i}" in t for t in sevens) for i in range(3))
    assert sorted(t for i, t in got if i == "9") == ["", "", "one two three"]


def test_lines_odd_rows(odd_docs, make_docs):
    rows = linededup.line_matches(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_lines, r.removed))
    assert sorted(got[1]) == [(1, []), (1, [0])] and got[2] == [(0, [])] and got[3] == [(1, [])] and got[9] == [(4, [])]
    assert got[6] == [(1, [0])] and sorted(got[None]) == [(0, []), (1, [0])]
    assert linededup.line_matches(make_docs([])).collect() == []
