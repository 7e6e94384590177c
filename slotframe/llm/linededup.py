"""Line deduplication as an exact set-similarity join.

A line is the set of its words. Equal sets form a class, named by its first occurrence (document, line). Words
are ordered by rarity over all lines; two sets that are similar enough share one of their few rarest words (prefix
filter), so classes meet by the words of their prefixes. Where they meet, their sizes (length filter), the places
of the shared word (positional filter) and a picture of the sets in 128 bits (the parity of how many words fall into
each cell, which differs in no more cells than the sets in words) bound how many words they can share; what passes is verified on the whole sets.

Postings are dealt out by word to parts of like size, and cross the shuffle as packed records, many in a row.

Only whether a line has an earlier match matters. So for classes that meet another one finer pictures are drawn, and
each verifies the closest of those before it that these allow; classes that are removed by then, or have none, need no
more. The others verify all that pictures allow, so none is missed, while a large family of variants costs a pair for
each member.

A word with many classes is cut into blocks by size and place of the word. Only blocks meet that the length and
positional filters allow to, each two of them under a key of their own, so no task holds more than two blocks of a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import join_counted, slices, stored
from slotframe.llm.minhash import halved
from slotframe.llm.shingles import M1, mix64, word_hashes

BUCKETS = 1 << 18
PIECE = 4096
SIEVE_BITS, SIEVE_PIECE = 1 << 24, 1 << 15
LAST = 9223372036854775807
"""Rows without an id come after all others."""
BLOCK = 4096
"""Classes of one word that meet in one block."""
CELLS = 13
"""Finer pictures have 2 to the power of 13 cells at most, whatever the length of a line."""
ROOM = 32_000_000
PAIRS = 1 << 16
"""Pairs tried in one step, about."""
PART = 1 << 18
"""Postings that meet in one part, about."""
SHARE = 16
"""Busy words are sought among the classes of one part in so many; those it misses are found where postings meet."""
RECORD = np.dtype([("key", "<i4"), ("line", "<i4"), ("n", "<i4"), ("place", "<i4"), ("doc", "<i8"), ("bits", "<i8"), ("more", "<i8")])
LINE = ["doc", "line", "digest", "n", "bits", "more", "prefix", "again"]
POSTING = "token int, doc long, line int, size long, bits long"
KEYED = "key long, doc long, line int, size long, bits long, side int"
BOTH = 2
"""The side of rows that meet all others under their key; rows of side 0 meet those of side 1."""


def cut_lines(texts: list[str | None]) -> tuple[np.ndarray, list[bytes]]:
    """How many lines each text has, and all lines. A null text has none."""
    split = [t.encode("utf-8", "surrogatepass").split(b"\n") if t is not None else [] for t in texts]
    return np.fromiter(map(len, split), np.int64, len(split)), [line for lines in split for line in lines]


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(46)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, 0, 2_000_000):
        raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist() if t]
        if raw:
            total += np.bincount(bucket(word_hashes(raw)[0]), minlength=BUCKETS)
    parts = total.reshape(-1, PIECE)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                     ["piece", "counts"])


def add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[piece] = total.get(piece, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                     ["piece", "counts"])


def rarity(docs: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences of all words in the corpus, by BUCKETS hash buckets. Any one order of words keeps the join exact; this
    one, of fixed size, puts rare words first."""
    pieces = docs.select(text_col).mapInArrow(count_words, "piece int, counts binary")
    summed = pieces.repartition(BUCKETS // PIECE, "piece").mapInArrow(add_pieces, "piece int, counts binary").collect()
    counts = np.zeros((BUCKETS // PIECE, PIECE), np.int64)
    for row in summed:
        counts[row["piece"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(counts.ravel(), (1 << 40) - 1)


def token_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line, line after line, in one order for all; and how many each line has."""
    hashed, counts = word_hashes(lines)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
    room = np.uint64(max(1, int(len(lines)).bit_length()))
    order = np.argsort((owner << (np.uint64(64) - room)) | (hashed >> room))
    hashed, owner = hashed[order], owner[order]
    fresh = np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])) if len(hashed) else np.zeros(0, bool)
    hashed, owner = hashed[fresh], owner[fresh].astype(np.int64)
    return hashed, np.bincount(owner, minlength=len(lines))


def ordered(values: np.ndarray) -> np.ndarray:
    """The places of the values from small to large, equal ones as they stand. Values are not negative; where they leave room
    for the places, one plain sort does."""
    room = int(len(values)).bit_length()
    if len(values) and int(values.max()).bit_length() + room > 63:
        return np.argsort(values, kind="stable")
    return np.sort(values << room | np.arange(len(values))) & ((1 << room) - 1)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def describe(counts: np.ndarray, percent: int, texts: bool = False) -> Callable:
    """Rows (id, text) to lines: digest of the set, its size, its prefix and its picture: which of 64 cells are odd, and which
    cells of 128 are, of those in the upper half. A prefix has half of each word's hash: where
    halves agree by chance, classes meet that need not, and whole sets are verified in any case. ``again`` marks the
    lines of a set that the same text has before. With ``texts`` each text has a row of its own beside its lines, of no words and with
    the number of its lines."""
    rank = np.zeros(BUCKETS, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 500_000):
            per, lines = cut_lines(batch.column(1).to_pylist())
            if texts:
                some, zero = batch.num_rows, np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(per.astype(np.int32)), pa.nulls(some, pa.binary()), pa.array(zero.astype(np.int32)),
                     pa.array(zero), pa.array(zero), pa.nulls(some, pa.list_(pa.int32())), pa.array(zero != 0)], LINE)
            tokens, n = token_sets(lines)
            start = np.cumsum(n) - n
            full = np.flatnonzero(n)
            if not len(full):
                continue
            owner = np.repeat(np.arange(len(lines)), n)
            with np.errstate(over="ignore"):
                digest = np.stack([np.add.reduceat(mix64(tokens + M1), start[full]), np.add.reduceat(mix64(tokens ^ M1), start[full])], 1)
            cell = mix64(tokens)
            mark = np.uint64(1) << (cell & np.uint64(63))
            bits = np.bitwise_xor.reduceat(mark, start[full])
            more = np.bitwise_xor.reduceat(np.where(cell & np.uint64(64), mark, np.uint64(0)), start[full])
            order = ordered(owner * BUCKETS + rank[bucket(tokens)])  # words of one bucket stay in the order of their hashes
            place = np.arange(len(tokens)) - start[owner]
            kept = order[place < prefix_length(n, percent)[owner]]
            sizes = prefix_length(n[full], percent)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            doc = np.repeat(np.arange(batch.num_rows), per)[full]
            number = (np.arange(len(lines)) - np.repeat(np.cumsum(per) - per, per))[full]
            same = np.lexsort((digest[:, 1], digest[:, 0], doc))  # lines of one set and text stay in their order
            again = np.zeros(len(full), bool)
            again[same[1:]] = (doc[same[1:]] == doc[same[:-1]]) & (digest[same[1:]] == digest[same[:-1]]).all(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)),
                 pa.array([d.tobytes() for d in digest], pa.binary()), pa.array(n[full].astype(np.int32)), pa.array(bits.view(np.int64)),
                 pa.array(more.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array((tokens[kept] >> np.uint64(32)).astype(np.uint32).view(np.int32))), pa.array(again)], LINE)
    return run


def sieve_at(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(doc.astype(np.int64).view(np.uint64) * M1 + line.astype(np.uint64)) & np.uint64(SIEVE_BITS - 1)).astype(np.int64)


def wanted_sets(sieve: np.ndarray) -> Callable:
    """Word sets of the lines that a sieve lets through: all that are wanted, and few others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2_000_000):
            per, lines = cut_lines(batch.column(1).to_pylist())
            doc = np.repeat(batch.column(0).to_numpy(), per)
            number = np.arange(len(lines)) - np.repeat(np.cumsum(per) - per, per)
            at = sieve_at(doc, number)
            own = np.flatnonzero(sieve[at >> 3] & (1 << (at & 7)).astype(np.uint8))
            tokens, n = token_sets([lines[i] for i in own])
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[own]), pa.array(number[own].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))], ["doc", "line", "words"])
    return run


def mark_sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sieve_at(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["at"])


def piece_bits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of one piece of a sieve to its bytes."""
    out = np.zeros(SIEVE_PIECE // 8, np.uint8)
    for batch in batches:
        at = batch.column("at").to_numpy() % SIEVE_PIECE
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([out.tobytes()])], ["piece", "bits"])


def pieces_of(marks: DataFrame) -> DataFrame:
    """The pieces (piece, bits) of a sieve of SIEVE_BITS bits that have any of those at ``at`` set."""
    return marks.select(F.expr(f"at div {SIEVE_PIECE}").alias("piece"), "at").groupBy("piece").applyInArrow(piece_bits, "piece long, bits binary")


def sieve_from(marks: DataFrame) -> np.ndarray:
    """The whole sieve; it is put together in Spark and reaches the driver as bytes."""
    out = np.zeros((SIEVE_BITS // SIEVE_PIECE, SIEVE_PIECE // 8), np.uint8)
    for row in pieces_of(marks).collect():
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def sieve_of(names: DataFrame) -> np.ndarray:
    """A bit for each name's hash, whatever the number of names."""
    return sieve_from(names.select("doc", "line").mapInArrow(mark_sieve, "at long"))


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many words sets of n and m words must share."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def meetings(columns: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (earlier class, later class) under one key that all filters let pass, some PAIRS of those tried in a step. Rows
    (key, doc, line, size, bits, side) are sorted by key and number of words. They may have the upper half of a picture of twice the
    cells at their end."""
    key, doc, line, size, bits, side, *more = columns
    if not len(key):
        return
    n, rest = size >> 32, (size >> 32) - (size & 0xFFFFFFFF)
    group = np.cumsum(np.append(True, key[1:] != key[:-1]))
    # sizes only grow: a row has enough words left for one behind it only if it has for one of its own size
    own = np.flatnonzero(rest >= least_common(n, n, percent))
    most = np.minimum(n[own] * 100 // percent, 0xFFFFFFFF)
    reach = np.searchsorted(group << 32 | n, group[own] << 32 | most, side="right") - own - 1
    own, reach = own[reach > 0], reach[reach > 0]
    cuts = np.flatnonzero(np.diff((np.cumsum(reach) - reach) // PAIRS)) + 1
    for i, per in zip(np.split(own, cuts), np.split(reach, cuts)):
        a = np.repeat(i, per)
        b = np.arange(len(a)) + np.repeat(i + 1 - np.cumsum(per) + per, per)
        need = least_common(n[a], n[b], percent)
        ok = np.flatnonzero(np.minimum(rest[a], rest[b]) >= need)
        a, b, need = a[ok], b[ok], need[ok]
        mixed = (bits[a] ^ bits[b]).view(np.uint64)
        if more:
            upper = (more[0][a] ^ more[0][b]).view(np.uint64)
            differ = np.bitwise_count(upper).astype(np.int64) + np.bitwise_count(mixed ^ upper)
        else:
            differ = np.bitwise_count(mixed).astype(np.int64)
        ok = np.flatnonzero((n[a] + n[b] - differ) // 2 >= need)
        a, b = a[ok], b[ok]
        ok = ((side[a] != side[b]) | (side[a] == BOTH)) & ((doc[a] != doc[b]) | (line[a] != line[b]))
        a, b = a[ok], b[ok]
        less = (doc[a] < doc[b]) | ((doc[a] == doc[b]) & (line[a] < line[b]))
        if len(a):
            yield np.where(less, a, b), np.where(less, b, a)


def by_key(found: Callable, width: int, rows: int = 1 << 17, size: int = 1 << 24) -> Callable:
    """Hands on the rows of whole keys, many keys at a time; rows are sorted by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        count = taken = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)])
            count, taken = count + batch.num_rows, taken + batch.nbytes
            if count < rows and taken < size:
                continue
            held = [np.concatenate(x) for x in zip(*parts)]
            last = int(np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))[-1])
            if last:
                yield from found([x[:last] for x in held])
                held = [x[last:] for x in held]
            parts, count, taken = [held], len(held[0]), 0
        if parts:
            yield from found([np.concatenate(x) for x in zip(*parts)])
    return run


def deal(parts: int, busy: np.ndarray) -> Callable:
    """Classes (doc, line, n, bits, more, prefix) to their postings, packed by part. A word has one part; postings of ``busy``
    words, which meet elsewhere, go to all parts alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(5).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(held) - held) // PART)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(held)]):
                some, per = batch.slice(lo, hi - lo), held[lo:hi]
                owner = np.repeat(np.arange(hi - lo), per)
                key, place = some.column(5).flatten().to_numpy(), np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
                spread = some.column(0).to_numpy() + some.column(1).to_numpy()
                by = np.where(np.isin(key, busy), spread[owner], key).astype(np.int64)
                part = (mix64(by.view(np.uint64) + M1) % np.uint64(parts)).astype(np.min_scalar_type(parts))
                order = np.argsort(part, kind="stable")
                ends, owner = np.cumsum(np.bincount(part, minlength=parts)), owner[order]
                rows = np.empty(len(owner), RECORD)
                rows["key"], rows["place"] = key[order], place[order]
                for k, name in enumerate(("doc", "line", "n", "bits", "more")):
                    rows[name] = some.column(k).to_numpy()[owner]
                own = np.flatnonzero(np.diff(ends, prepend=0))
                packed = [rows[e - c: e].tobytes() for e, c in zip(ends[own].tolist(), np.diff(ends, prepend=0)[own].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "rows"])
    return run


def meet(percent: int, busy: np.ndarray) -> Callable:
    """Packed postings of whole parts to those that meet another one, and to all postings of busy words: ``busy`` ones and all
    that have more than BLOCK postings."""
    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(columns[1]), RECORD)
        rows = rows[np.argsort(rows["key"].astype(np.int64) << 32 | rows["n"])]
        size = rows["n"].astype(np.int64) << 32 | rows["place"]
        key = rows["key"].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        hot = np.repeat((count > BLOCK) | np.isin(rows["key"][first], busy), count)
        alone = np.repeat(count < 2, count)
        for own, is_hot in ((hot, True), (~hot & ~alone, False)):
            own = np.flatnonzero(own)
            held = [key[own], *[np.ascontiguousarray(rows[c][own]) for c in ("doc", "line")], size[own],
                    np.ascontiguousarray(rows["bits"][own]), np.full(len(own), BOTH, np.int32)]
            if not is_hot and len(own):
                seen = np.zeros(len(own), bool)
                for a, b in meetings([*held, np.ascontiguousarray(rows["more"][own])], percent):
                    seen[a] = seen[b] = True
                held = [c[seen] for c in held]
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(np.full(len(held[0]), is_hot))],
                                                 ["key", "doc", "line", "size", "bits", "side", "hot"])
    return by_key(found, 2)


def met(classes: DataFrame, percent: int) -> DataFrame:
    """Postings (KEYED) that meet another one under their key: their word, or two blocks of a busy word."""
    prefix = classes.select("doc", "line", "n", "bits", "more", "prefix")
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    some = prefix.where(F.pmod(F.xxhash64("doc", "line"), F.lit(SHARE)) == 0).select(F.explode("prefix").alias("token"))
    words = some.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") * SHARE > 4 * BLOCK).collect()
    busy, parts = np.array([r["token"] for r in words], np.int32), 1 + total // PART
    packed = prefix.mapInArrow(deal(parts, busy), "part int, rows binary").repartition(parts, "part").sortWithinPartitions("part")
    found = stored(packed.mapInArrow(meet(percent, busy), f"{KEYED}, hot boolean"), "meetings")
    members = found.where("not hot").drop("hot")
    hot = found.where("hot").select(F.col("key").cast("int").alias("token"), "doc", "line", "size", "bits")
    several = stored(hot.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "meeting-words")
    if not several.limit(1).count():
        return members
    sorted_ = keyed(hot, several, percent).repartition("key").sortWithinPartitions("key", "size")
    return members.unionByName(stored(sorted_.mapInArrow(partners(percent), KEYED), "busy-meetings"))


def partners(percent: int) -> Callable:
    """Classes that meet another one."""
    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(columns[0]), bool)
        for first, then in meetings(columns, percent):
            seen[first] = seen[then] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in columns], ["key", "doc", "line", "size", "bits", "side"])
    return by_key(found, 6)


def fine_picture(words: np.ndarray) -> bytes:
    """For each of some cells, 8 to 16 for each word up to a fixed number, whether an odd number of words falls into it."""
    bits = min(CELLS, max(6, 3 + int(len(words) - 1).bit_length()))
    odd = np.bincount((words.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def draw_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, line, words) to finer pictures of the whole sets."""
    for batch in batches:
        drawn = [fine_picture(np.asarray(v)) for v in batch.column(2).to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(drawn, pa.binary())], ["doc", "line", "picture"])


class Pictures:
    """Pictures of several sizes. The coarser of two decides: neighbouring cells of the finer one are put together."""

    def __init__(self, drawn: np.ndarray) -> None:
        self.width = np.array([len(p) for p in drawn], np.int64)
        self.place, self.seen = np.zeros(len(drawn), np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.seen[w, w] = np.frombuffer(b"".join(drawn[own]), np.uint8).reshape(-1, w)

    def at(self, width: int, coarse: int) -> np.ndarray:
        if (width, coarse) not in self.seen:
            self.seen[width, coarse] = halved(self.at(width, 2 * coarse))
        return self.seen[width, coarse]

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many cells the pictures of each pair differ: in no more than their sets in words."""
        out = np.zeros(len(a), np.int64)
        kinds = self.width[a] << 32 | self.width[b]
        for kind in np.unique(kinds).tolist():
            v, w = kind >> 32, kind & 0xFFFFFFFF
            own, least = np.flatnonzero(kinds == kind), min(v, w)
            x, y = self.at(v, least), self.at(w, least)
            for some in np.array_split(own, 1 + len(own) * least // ROOM):
                mixed = x[self.place[a[some]]] ^ y[self.place[b[some]]]
                out[some] = np.bitwise_count(mixed.view(np.uint64)).sum(1, dtype=np.int64)
        return out


def open_pairs(percent: int, every: bool) -> Callable:
    """Pairs (doc, line, doc2, line2, score) whose later class is open (flag in the last column but one) and whose pictures (last
    column) allow it: all of them, or for each open class and key the closest earlier one."""
    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, line, size, is_open = columns[1], columns[2], columns[3], columns[6]
        if not is_open.any():
            return
        n, pictures = size >> 32, Pictures(columns[7])
        best, score = np.full(len(doc), -1, np.int64), np.full(len(doc), np.inf)

        def rows(first: np.ndarray, then: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], line[first], doc[then], line[then], -apart)],
                                              ["doc", "line", "doc2", "line2", "score"])

        for first, then in meetings(columns[:6], percent):
            ok = is_open[then] != 0
            first, then = first[ok], then[ok]
            total, differ = n[first] + n[then], pictures.differing(first, then)
            ok = differ <= total - 2 * least_common(n[first], n[then], percent)
            first, then, apart = first[ok], then[ok], (differ / total)[ok]
            if every and len(first):
                yield rows(first, then, apart)
            order = np.lexsort((apart, then))  # the closest one of each later class, which may meet several in a step
            order = order[np.append(True, np.diff(then[order]) != 0)[: len(order)]]
            order = order[apart[order] < score[then[order]]]
            best[then[order]], score[then[order]] = first[order], apart[order]
        kept = np.flatnonzero(best >= 0)
        if not every and len(kept):
            yield rows(best[kept], kept, score[kept])
    return by_key(found, 8)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc, line) of the pairs (doc, line, doc2, line2) whose whole sets are similar enough."""
    one = sets.select("doc", "line", F.col("words").alias("_a"))
    two = sets.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("words").alias("_b"))
    # each end is found by itself, so what is joined in the end has the sets of pairs only
    rows = pairs.join(one, ["doc", "line"]).join(pairs.join(two, ["doc2", "line2"]), ["doc", "line", "doc2", "line2"])
    rows = rows.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    rows = rows.where(F.col("_both") * 100 >= percent * (F.size("_a") + F.size("_b") - F.col("_both")))
    later = F.greatest(F.struct("doc", "line"), F.struct(F.col("doc2").alias("doc"), F.col("line2").alias("line")))
    return rows.select(later.alias("_later")).select("_later.doc", "_later.line").distinct()


def keyed(postings: DataFrame, several: DataFrame, percent: int) -> DataFrame:
    """Postings by the key under which they meet: their word, or for a word with more than BLOCK of them two blocks that may
    hold similar sets. Blocks follow sizes and places, of which a word has few; large ones are spread over several blocks."""
    cold = postings.select(F.col("token").cast("long").alias("key"), "doc", "line", "size", "bits", F.lit(BOTH).alias("side"))
    hot = several.where(F.col("rows") > BLOCK).select("token")
    if not hot.limit(1).count():
        return cold
    busy = postings.join(hot, "token", "left_semi")
    before = F.sum("rows").over(Window.partitionBy("token").orderBy("size")) - F.col("rows")
    cells = stored(busy.groupBy("token", "size").agg(F.count("*").alias("rows")).withColumn("start", before), "cells")
    spans = cells.select("token", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(0xFFFFFFFF).alias("place"),
                         F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + rows - 1) div {BLOCK}"))).alias("block"))
    spans = stored(spans.groupBy("token", "block", "n").agg(F.min("place").alias("place")), "spans")
    one = spans.toDF("token", "lo", "n", "place")
    two = spans.toDF("token", "hi", "m", "place2")
    may = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2")) >= F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    faces = one.join(two, "token").where((F.col("lo") <= F.col("hi")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & may)
    faces = stored(faces.select("token", "lo", "hi").distinct(), "faces")
    turns = faces.select("token", F.col("lo").alias("block"), "lo", "hi", F.when(F.col("lo") == F.col("hi"), BOTH).otherwise(0).alias("side"))
    turns = turns.unionByName(faces.where("lo < hi").select("token", F.col("hi").alias("block"), "lo", "hi", F.lit(1).alias("side")))
    busy = busy.join(cells, ["token", "size"]).withColumn("block", F.expr(f"(start + pmod(xxhash64(doc, line), rows)) div {BLOCK}"))
    busy = busy.join(turns, ["token", "block"]).select(F.xxhash64("token", "lo", "hi").alias("key"), "doc", "line", "size", "bits", "side")
    return cold.join(hot.select(F.col("token").cast("long").alias("key")), "key", "left_anti").unionByName(busy)


def earlier(members: DataFrame, left: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (doc, line, doc2, line2) of an earlier class and an open one (``left``, at first all that are ``members``) that
    pictures allow: the closest for each open class, or all of them, which looks only at keys with an open class."""
    marked = members.withColumn("_open", F.lit(1))
    if every:
        keys = members.join(left, ["doc", "line"], "left_semi").select("key").distinct()
        marked = members.join(left.withColumn("_open", F.lit(1)), ["doc", "line"], "left").join(keys, "key", "left_semi")
    drawn = sets.mapInArrow(draw_sets, "doc long, line int, picture binary")
    marked = marked.join(drawn, ["doc", "line"]).select("key", "doc", "line", "size", "bits", "side", F.coalesce("_open", F.lit(0)).alias("open"), "picture")
    marked = marked.repartition("key").sortWithinPartitions("key", "size")
    pairs = marked.mapInArrow(open_pairs(percent, every), "doc long, line int, doc2 long, line2 int, score double")
    if every:
        return pairs.select("doc", "line", "doc2", "line2").distinct()
    pairs = pairs.groupBy("doc2", "line2").agg(F.max_by(F.struct("doc", "line"), F.struct("score", "doc", "line")).alias("p"))
    return pairs.select("p.doc", "p.line", "doc2", "line2")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, text): a number of its own for each row, rising with the id, rows without one last. Ids that differ are the
    numbers themselves; where rows share an id or have none, rows are sorted by (id, text hash) once and numbered."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not rows.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        return rows
    mark = F.xxhash64("text")
    rows = rows.repartitionByRange("doc", mark).sortWithinPartitions("doc", mark)
    return stored(rows.withColumn("doc", F.monotonically_increasing_id()), "line-rows")


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id, n_lines, removed (the numbers of its lines, from 0, that have an earlier match),
    and (copy, digest), which tell rows of one id apart.

    Lines end at line feeds. A line matches if the sets of its words, A-Z in lower case, have 100 * intersection >=
    percent * union, and is removed if any line before it, by (id, line number), matches, removed or not. Lines without
    words never match. A null text has no lines and an empty one has one. Rows that share an id are documents of their own, in
    the order of a hash of their texts, and so are rows without an id, which come after all others; of equal rows the first
    keeps its lines. Empty input: no rows.
    """
    own = numbered(docs, id_col, text_col)
    counts = rarity(docs, text_col)
    lines = own.select("doc", "text").mapInArrow(
        describe(counts, percent, texts=True), "doc long, line int, digest binary, n int, bits long, more long, prefix array<int>, again boolean")
    lines = stored(lines, "lines")
    # lines of one digest differ in their places only; each text has one that is not there again, so the least document names the first
    doc = F.when(~F.col("again"), F.col("doc"))
    classes = lines.where("n > 0").groupBy("digest", "n", "bits", "more", "prefix").agg(
        F.min(doc).alias("doc"), F.min_by("line", doc).alias("line"), F.count("*").alias("rows"))
    classes = stored(classes.select("digest", "doc", "line", "rows", "n", "bits", "more", "prefix"), "line-classes")
    members = met(classes, percent)

    names = stored(members.select("doc", "line").distinct(), "meeting-lines")
    sets = own.select("doc", "text").mapInArrow(wanted_sets(sieve_of(names)), "doc long, line int, words array<long>")
    if names.count() > SIEVE_BITS // 8:  # a full sieve lets through much that is not wanted, which is no fault but room
        sets = sets.join(names, ["doc", "line"], "left_semi")
    sets = stored(sets, "word-sets")

    nearest = stored(earlier(members, names, sets, percent, every=False), "nearest")
    gone = stored(verified(nearest, sets, percent), "matched")
    left = stored(nearest.select(F.col("doc2").alias("doc"), F.col("line2").alias("line")).join(gone, ["doc", "line"], "left_anti"), "open")
    pairs = stored(earlier(members, left, sets, percent, every=True), "open-pairs")
    gone = gone.unionByName(verified(pairs, sets, percent)).distinct()
    return _by_document(own, lines, classes, gone, id_col)


def _by_document(own: DataFrame, lines: DataFrame, classes: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Removed lines of each document: all of a removed class, and all but the first of any other."""
    ends = classes.select("digest", "doc", "line", "rows").join(gone.withColumn("_gone", F.lit(True)), ["doc", "line"], "left")
    ends = ends.where("rows > 1 or _gone").select("digest", "rows", F.col("doc").alias("_doc"), F.col("line").alias("_line"),
                                                  F.coalesce("_gone", F.lit(False)).alias("_gone"))
    ends = stored(ends, "line-ends")
    worded = lines.where("n > 0").select("doc", "line", "digest")
    rows = join_counted(worded, ends, "digest", "rows", worded.count(), F.struct("doc", "line"))
    rows = rows.where("_gone or doc <> _doc or line <> _line").select("doc", "line", F.lit(None).cast("int").alias("n_lines"))
    rows = rows.unionByName(lines.where("n = 0").select("doc", F.lit(None).cast("int").alias("line"), F.col("line").alias("n_lines")))
    removed = rows.groupBy("doc").agg(F.max("n_lines").cast("long").alias("n_lines"), F.array_sort(F.collect_set("line")).alias("removed"))
    texts = own.select("doc", "id", F.xxhash64("text").alias("digest")).join(removed, "doc")
    return texts.select(F.col("id").alias(id_col), "n_lines", "removed", _copy("id", "digest", "doc"), "digest")


def _copy(id_col: str, digest: str | Column, *order: str | Column) -> Column:
    """The number of a row among those of equal id and text; which of them comes first makes no difference to the texts."""
    return F.row_number().over(Window.partitionBy(id_col, digest).orderBy(*order)).alias("copy")


def remove_lines(docs: DataFrame, matches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the matched lines cut out of their texts; all other columns stay."""
    columns = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*columns.values()).withColumn("_digest", F.xxhash64(columns[text_col]))
    rows = rows.withColumn("_copy", _copy(columns[id_col], "_digest", F.monotonically_increasing_id()))
    cuts = matches.where(F.size("removed") > 0).select(F.col(id_col).alias("_id"), "digest", "copy", F.col("removed").alias("_removed"))
    same = F.col(columns[id_col]).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("digest")) & (F.col("_copy") == F.col("copy"))
    rows = rows.join(cuts, same, "left")
    text = F.col(columns[text_col])
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_removed", F.array().cast("array<int>")), i))
    shown = F.when(F.col("_removed").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[(shown if c == text_col else F.col(n)).alias(c) for c, n in columns.items()])
