"""Fill-in-the-middle over frames against plain strings, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from slotframe.llm import fim


def plain(doc_id, text, rate=100, spm=50):
    """The contract on one whole string."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h4 % 100 < spm else "psm", len(prefix), len(middle), out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    rng = random.Random(2)
    alphabet = ["a", "é", "\n", "\n", "語", "😀", " ", "<", ">", "P", "S", "M", "\r", " "]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 5, 30, 200, 3000])))) for i in range(250)]
    return rows + [(300, "\n" * 70), (301, "x" * 900), (302, "one\ntwo"), (303, "one\ntwo\n"), (304, "a <P> b"), (305, "<S>"), (306, "<" * 50 + "S"),
                   (None, "no id\nat all"), (None, None), (307, None), (308, ""), (302, "one\ntwo"), (302, "other\ntext\nunder one id"), (309, "<M" + "\n>")]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 18])
def test_same_as_plain_strings(spark, make_docs, size):
    rows = texts()
    docs = make_docs([(*r, "en", "a") for r in rows])
    framed = fim.frame_texts(docs, F.struct("doc_id", F.lit(1).alias("x")), frame_bytes=size)
    out = fim.fill_in_middle(framed, F.col("key.doc_id"), frame_bytes=size)
    found = fim.digests(out).select("key.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    want = [(i, *w[:4], sha(w[4]), sha(t or "")) for i, t in rows for w in [plain(i, t)]]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    if size == 64:
        assert sorted((r.doc_id, r.text) for r in fim.read_texts(out).select("key.doc_id", "text").collect() if r.doc_id is not None) == \
            sorted((i, plain(i, t)[4]) for i, t in rows if i is not None)


def test_rates(spark, make_docs):
    rows = [(i, f"line {i}\nnext\nlast") for i in range(300)]
    framed = fim.frame_texts(make_docs([(*r, "en", "a") for r in rows]), F.col("doc_id"))
    for rate, spm in ((0, 50), (40, 100), (70, 0)):
        got = {r.key: r.form for r in fim.fill_in_middle(framed, F.col("key"), rate=rate, spm_rate=spm).select("key", "form").collect()}
        assert got == {i: plain(i, t, rate, spm)[1] for i, t in rows}


def test_only_cut_frames_are_opened():
    """A cut is found by counts: one frame is decompressed for it, wherever it lies."""
    raw = "".join(f"line {i} é\n" for i in range(5000)).encode()
    writer = fim.Writer(512)
    writer.add(raw)
    text = fim.Reader(writer.done(), writer.bytes)
    opened = []
    text.raw = lambda i, f=text.raw: opened.append(i) or f(i)
    for u in (0, 1, 777, 4999, 5000):
        opened.clear()
        cut = text.after_unit(u, writer.chars)
        want = "".join(f"line {i} é\n" for i in range(u))
        assert cut == (len(want.encode()), len(want)) and len(opened) <= 1
    assert b"".join(text.part(1000, 9000)) == raw[1000:9000] and b"".join(text.part(5, 5)) == b""


def test_very_long_text_and_empty_table(spark, make_docs):
    long = "".join(f"row {i} of a long text\n" for i in range(200_000)) + "z" * 3_000_000
    docs = make_docs([(1, long, "en", "a"), (2, "short", "en", "a")])
    got = {r.key: tuple(r)[1:] for r in fim.digests(fim.fill_in_middle(fim.frame_texts(docs, F.col("doc_id")), F.col("key"))).drop("bytes").collect()}
    for i, t in ((1, long), (2, "short")):
        w = plain(i, t)
        assert got[i] == (*w[:4], sha(w[4]), sha(t))
    assert fim.digests(fim.fill_in_middle(fim.frame_texts(make_docs([]), F.col("doc_id")), F.col("key"))).count() == 0
