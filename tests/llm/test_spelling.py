"""Spelling variants against brute force, and the parts: hashes of edits, filters, passes."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from slotframe.llm import spelling
from slotframe.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = counted(rows)
    form, count = {}, {}
    for w in words:
        others = [v for v in words if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], count[w], words[form[w]] if form[w] else None))
    return out


def invented(seed=4, texts=60):
    """Words with many variants, chains of forms, ties, letters beyond A-Z."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé÷ßÀÿ", k=rng.randint(4, 11))) for _ in range(60)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([1, 8, 8, 64])
        for _ in range(6):
            i = rng.randrange(len(w))
            pool += [rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abxyÿ") + w[i:], w[:i] + rng.choice("abxyÀ") + w[i + 1:]])] * rng.choice([1, 2, 4, 16])
    return [(i, " ".join(rng.choices(pool, k=80)).title() + rng.choice([" ", "1", "\n"])) for i in range(texts)]


def found(docs, **more):
    rows = spelling.spelling_variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def test_same_as_brute_force(spark, make_docs):
    rows = invented()
    want = brute(rows)
    assert sum(w[1] is not None and w[2] != w[1] for w in want) > 3 and len(want) > 100
    docs = make_docs([(*r, "en", "a") for r in rows])
    assert found(docs) == want


def test_many_small_filters(spark, make_docs, monkeypatch):
    """A budget of a few blocks: lengths fall into parts, and passes follow one another."""
    monkeypatch.setattr(spelling, "SEGMENT_BLOCKS", 2)
    monkeypatch.setattr(spelling, "WORD_BITS", 100)
    rows = invented(5)
    sizes = Counter(map(len, counted(rows)))
    passes = spelling.plan(sizes, 256)
    assert len(passes) > 3 and any(s.parts > 1 for p in passes for s in p)
    assert all(sum(s.blocks for s in p) * 64 <= 256 for p in passes)
    assert found(make_docs([(*r, "en", "a") for r in rows]), budget=256) == brute(rows)


def test_odd_rows(spark, odd_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows)
    long = "é" * 30_000
    rows = [(i, f"{long} {long}x {long[:-1]}ê letters lettres") for i in range(6)] + [(None, "letters lettars " * 4), (3, None), (4, "")]
    assert found(make_docs([(*r, None, None) for r in rows])) == brute(rows)
    assert found(make_docs([])) == set() and found(make_docs([(1, "one two", "en", "a")])) == set()


@pytest.mark.parametrize("step", [1 << 21, 64])
def test_edit_hashes(monkeypatch, step):
    monkeypatch.setattr(spelling, "EDITS", step)
    words = [b"banana", b"aabbcc", bytes([0xE9, 0xE9, 0xFF, 0xC0, 97, 98])]
    letters = spelling.matrix(words)
    one = lambda w: spelling.hashes(spelling.matrix([w]))[0]
    seen = set()
    for r, p, h in spelling.deletions(letters):
        for a, b, x in zip(r, p, h):
            edit = words[a][:b] + words[a][b + 1:]
            assert x == one(edit)
            seen.add((int(a), edit))
    assert seen == {(a, w[:i] + w[i + 1:]) for a, w in enumerate(words) for i in range(len(w))}
    alphabet = np.array([97, 98, 0xFE], np.uint8)
    seen = set()
    for r, p, c, h in spelling.replacements(letters, spelling.hashes(letters), alphabet):
        for a, b, x, y in zip(r, p, c, h):
            edit = words[a][:b] + bytes([x]) + words[a][b + 1:]
            assert y == one(edit)
            seen.add((int(a), edit))
    assert seen == {(a, w[:i] + bytes([c]) + w[i + 1:]) for a, w in enumerate(words) for i in range(len(w)) for c in alphabet.tolist() if c > w[i]}


def test_filters_pass_few_strangers(spark):
    words = [f"word{i:05d}".encode() for i in range(4000)]
    vocabulary = spark.createDataFrame([(w.decode(), bytearray(w), 3) for w in words], "word string, letters binary, n long")
    (shards,) = spelling.plan({9: 4000}, 1 << 20)
    bits = spelling.filters(vocabulary, shards)
    own, others = (spelling.hashes(spelling.matrix(w)) for w in (words, [f"ward{i:05d}".encode() for i in range(4000)]))
    assert len(spelling.passing(shards[0], bits[0], own)) == 4000
    assert len(spelling.passing(shards[0], bits[0], others)) < 80


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    rows = [tuple(r) for r in docs]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and "op12_spelling_variants" in QUERIES
