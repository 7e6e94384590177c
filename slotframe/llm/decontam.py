"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

The index holds, for each term, its items with their BM25 weights, divided by what the item itself would score,
so a score is the share of an item that a passage holds and one threshold fits all items. Items are
filed in blocks, and each term keeps its largest weight over all items and within each block. A
passage is left as soon as the largest weights of its terms cannot reach the threshold; then blocks
are left by their own largest weights; what remains is walked with WAND: cursors ordered by item, the
pivot being the first item whose terms can still reach the threshold. All items above the threshold are
retrieved, none else. Each is then verified by the words that question and answer have in order
in the passage and its surroundings.

Items are indexed in shards of bounded count and size. How many items hold a term, how many items there are and how
long they are on average is counted in Spark over all items, whatever their shard or window, so a score does not
depend on how items are dealt. The corpus is read once by ``find_leaks`` for each shard; ``drop_leaks`` passes it
through all shards at once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import slices, stored

K1, B = 1.2, 0.75
LEAST_WINDOW = 64
CELLS = 1 << 20
"""Words of passages that are compared at a time."""
BLOCK = 4
SHARD_ITEMS = 1024
SHARD_BYTES = 4_000_000
THRESHOLD = 0.6
QUESTION, ANSWER = 0.8, 0.5
HITS = "item_id long, word_at long, score double, question_overlap double, answer_overlap double"
WORD_BYTES = bytes(i if i >= 128 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation, in lower case."""
    return (text or "").lower().encode("utf-8", "replace").translate(WORD_BYTES).split()


def halves(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that is one text: its last sentence is the answer, if there are more."""
    parts = (text or "").strip().replace("\n", " ").split(". ")
    return (". ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


class Terms(NamedTuple):
    """What the weights need to know of all items: their number, their mean length, and how many hold a term."""

    items: int
    mean: float
    frequency: Mapping[bytes, int]


class Index:
    """Items whose passages are windows of one length."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], window: int, terms: Terms) -> None:
        self.window, self.items = window, items
        counts = [Counter(q + a) for _, q, a in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        idf = {t: math.log(1 + (terms.items - terms.frequency[t] + 0.5) / (terms.frequency[t] + 0.5)) for t in self.vocabulary}
        self.blocks = -(-len(items) // BLOCK)
        size = len(self.vocabulary)
        self.most = np.zeros(size + 1, np.float32)
        self.block_most = np.zeros((size + 1, self.blocks), np.float32)
        self.postings: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(self.blocks)]
        for at, c in enumerate(counts):
            norm = K1 * (1 - B + B * sum(c.values()) / terms.mean)
            weights = {t: idf[t] * k * (K1 + 1) / (k + norm) for t, k in c.items()}
            own = sum(weights.values())
            for t, w in sorted(weights.items()):
                i, w = self.vocabulary[t], w / own
                self.most[i] = max(self.most[i], w)
                self.block_most[i, at // BLOCK] = max(self.block_most[i, at // BLOCK], w)
                self.postings[at // BLOCK][i].append((at, w))

    def retrieve(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of the block that score at least the threshold, by WAND."""
        lists = [(p, float(self.block_most[t, block])) for t in terms if (p := self.postings[block].get(t))]
        at = [0] * len(lists)
        found = []
        while True:
            live = sorted((lists[i][0][at[i]][0], i) for i in range(len(lists)) if at[i] < len(lists[i][0]))
            bound, pivot = 0.0, None
            for item, i in live:
                bound += lists[i][1]
                if bound >= threshold - 1e-6:
                    pivot = item
                    break
            if pivot is None:
                return found
            if live[0][0] == pivot:
                score = 0.0
                for item, i in live:
                    if item == pivot:
                        score += lists[i][0][at[i]][1]
                        at[i] += 1
                if score >= threshold:
                    found.append((pivot, score))
            else:
                for item, i in live:
                    if item >= pivot:
                        break
                    while at[i] < len(lists[i][0]) and lists[i][0][at[i]][0] < pivot:
                        at[i] += 1

    def candidates(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word, item, score) of the documents' passages; ``ids`` are the documents' terms, one after
        another, ``begin`` and ``end`` where each document lies."""
        step, none = self.window // 2, len(self.vocabulary)
        number = np.maximum(0, -(-(end - begin - self.window) // step)) + 1
        number[end == begin] = 0
        doc = np.repeat(np.arange(len(begin)), number)
        first = begin[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number))
        last = np.minimum(first + self.window, end[doc])
        mass = np.concatenate([[0.0], np.cumsum(self.most[ids], dtype=np.float64)])
        slack = threshold - 1e-6
        alive = np.flatnonzero(mass[last] - mass[first] >= slack)
        padded = np.append(ids, none)
        rows = max(1, CELLS // self.window)
        for lo in range(0, len(alive), rows):
            own = alive[lo: lo + rows]
            at = first[own][:, None] + np.arange(self.window)
            terms = np.sort(padded[np.where(at < last[own][:, None], at, len(ids))], axis=1)
            terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = none  # each term once
            some = self.most[terms].sum(1) >= slack
            own, terms = own[some], terms[some]
            group = max(1, min(256, 8 * CELLS // (self.window * max(1, self.blocks))))
            for low in range(0, len(own), group):
                bounds = self.bounds(terms[low: low + group])
                for row, block in zip(*np.nonzero(bounds >= slack)):
                    kept = terms[low + row]
                    for item, score in self.retrieve(kept[kept != none].tolist(), int(block), threshold):
                        yield int(doc[own[low + row]]), int(first[own[low + row]]), item, score

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each passage and block the most that an item can score with the passage's terms, so many terms at a time that
        memory does not follow the window."""
        step = max(1, 8 * CELLS // max(1, len(terms) * self.blocks))
        total = np.zeros((len(terms), self.blocks), np.float32)
        for lo in range(0, self.window, step):
            total += self.block_most[terms[:, lo: lo + step]].sum(1)
        return total


def common_in_order(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's words that the passage has in the same order (longest common subsequence). ``ends`` holds, for
    each length, the earliest place in the part where a common subsequence of that length can end; only places of equal words
    are visited."""
    if not part:
        return 1.0
    places = defaultdict(list)
    for i in range(len(part) - 1, -1, -1):
        places[part[i]].append(i)
    ends: list[int] = []
    for w in passage:
        for i in places.get(w, ()):
            k = bisect_left(ends, i)
            if k == len(ends):
                ends.append(i)
            else:
                ends[k] = i
    return len(ends) / len(part)


def parts(question: str | None, answer: str | None, answered: bool) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and answer."""
    if not answered:
        question, answer = halves(question)
    return words_of(question), words_of(answer)


def indexes(items: list[tuple[int, str | None, str | None]], answered: bool, terms: Terms) -> list[Index]:
    """One index for each length of window. Windows overlap by half and are at least twice as long as an item, so
    an item lies whole in one of them. Items without words are left out."""
    by: dict[int, list] = defaultdict(list)
    for item_id, question, answer in items:
        q, a = parts(question, answer, answered)
        if q or a:
            by[max(LEAST_WINDOW, 1 << (2 * (len(q) + len(a)) - 1).bit_length())].append((item_id, q, a))
    return [Index(found, window, terms) for window, found in sorted(by.items())]


def item_terms(answered: bool) -> object:
    """For each item its shard, the number of its words and its distinct terms, one row each; the first row of an
    item carries the number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for question, answer, shard in zip(*[batch.column(c).to_pylist() for c in ("q", "a", "shard")]):
                q, a = parts(question, answer, answered)
                terms = sorted(set(q + a))
                length = [len(q) + len(a)] + [None] * (len(terms) - 1) if terms else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.binary()), pa.array(length, pa.int64())],
                    names=["shard", "term", "length"])
    return run


def leaks_in(found: list[Index], texts: list[str | None], threshold: float, question: float,
             answer: float) -> dict[tuple[int, int], tuple]:
    """By position of the text and item: score, minus the first word of the best passage, overlaps."""
    docs = [words_of(t) for t in texts]
    flat = [w for d in docs for w in d]
    end = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(docs) else end
    rows: dict[tuple[int, int], tuple] = {}
    for index in found:
        none = len(index.vocabulary)
        ids = np.fromiter(map(index.vocabulary.get, flat, repeat(none)), np.int64, len(flat))
        for doc, first, at, score in index.candidates(ids, begin, end, threshold):
            item, q, a = index.items[at]
            lo = max(int(begin[doc]), first - index.window // 2)
            passage = flat[lo: min(int(end[doc]), first + index.window * 3 // 2)]
            shares = common_in_order(q, passage), common_in_order(a, passage)
            both = (shares[0] * len(q) + shares[1] * len(a)) / (len(q) + len(a))
            if both >= question and shares[1] >= answer:
                row = (score, -(first - int(begin[doc])), *shares)
                rows[doc, item] = max(rows.get((doc, item), row), row)
    return rows


def report(found: list[Index], *limits: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            rows = leaks_in(found, batch.column(batch.num_columns - 1).to_pylist(), *limits)
            where = pa.array([doc for doc, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(where) for c in batch.columns[:-1]], pa.array([item for _, item in rows], pa.int64()),
                 pa.array([-r[1] for r in rows.values()], pa.int64()),
                 *[pa.array([r[k] for r in rows.values()], pa.float64()) for k in (0, 2, 3)]],
                [*batch.schema.names[:-1], "item_id", "word_at", "score", "question_overlap", "answer_overlap"])
    return run


def clean(found: list[Index], column: int, *limits: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            bad = {doc for doc, _ in leaks_in(found, batch.column(column).to_pylist(), *limits)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch
    return run


def index_shards(benchmark: DataFrame, item_col: str, question_col: str, answer_col: str | None) -> Iterator[list[Index]]:
    """Indexes of bounded size, one shard of items after another."""
    columns = [F.col(item_col).cast("long").alias("id"), F.col(question_col).alias("q"),
               (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a")]
    items = benchmark.select(*columns).where("id is not null and (q is not null or a is not null)")
    items = items.select("id", F.coalesce("q", F.lit("")).alias("q"), F.coalesce("a", F.lit("")).alias("a"))
    items = items.distinct().withColumn("bytes", F.octet_length("q") + F.octet_length("a"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-size["bytes"] // SHARD_BYTES))
    shards = shards if shards == 1 else 2 * shards  # the hash deals unevenly
    answered = answer_col is not None
    items = stored(items.select("id", "q", "a", F.pmod(F.xxhash64("id", "q", "a"), F.lit(shards)).alias("shard")), "items")
    held = stored(items.mapInArrow(item_terms(answered), "shard long, term binary, length long"), "item_terms")
    total = held.agg(F.count("length").alias("n"), F.sum("length").alias("words")).first()
    # each term once per shard that has it, with the number of items that hold it in any shard
    per_shard = held.groupBy("term", "shard").agg(F.count("*").alias("n"))
    counted = per_shard.groupBy("term").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("shards"))
    counted = stored(counted.select(F.explode("shards").alias("shard"), "term", "n"), "item_term_counts")
    for shard in range(shards):
        frequency = {bytes(r["term"]): r["n"] for r in counted.where(F.col("shard") == shard).select("term", "n").collect()}
        terms = Terms(total["n"], (total["words"] or 0) / max(1, total["n"]), frequency)
        part = items.where(F.col("shard") == shard).select("id", "q", "a").collect()
        yield indexes(sorted((r["id"], r["q"], r["a"]) for r in part), answered, terms)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text",
               answer_col: str | None = None, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD,
               question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """A row for each row of ``docs`` and item found in it: the columns in ``keep``, item_id, word_at (where the
    best passage starts), score, question_overlap, answer_overlap.

    An item counts if a passage scores at least ``threshold`` and has at least ``question`` of all its words in order, and
    ``answer`` of its answer's. Without ``answer_col`` the last sentence of an item is its answer. Null and
    empty texts and items match nothing; rows that repeat are found each; items that repeat under one id
    count once; items without an id are left out.
    """
    own = docs.select(*keep, F.col(text_col).alias("_text")).where("_text is not null")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]], HITS])
    found = [own.mapInArrow(report(shard, threshold, question, answer), schema)
             for shard in index_shards(benchmark, item_col, question_col, answer_col)]
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text",
               answer_col: str | None = None, threshold: float = THRESHOLD, question: float = QUESTION,
               answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item by the rules of ``find_leaks``. Nothing is shuffled. Rows
    with a null text stay."""
    column = docs.columns.index(text_col)
    for shard in index_shards(benchmark, item_col, question_col, answer_col):
        docs = docs.mapInArrow(clean(shard, column, threshold, question, answer), docs.schema)
    return docs
