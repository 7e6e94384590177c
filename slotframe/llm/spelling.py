"""Spelling variants: words that differ in one code point, found by probing Bloom filters.

Words are counted in Spark. The vocabulary is cut into shards by word length, large lengths into several parts by hash, and
each shard gets a blocked Bloom filter that Spark builds segment by segment. Filters are broadcast a few shards at a
time, never more than FILTER_BYTES together; a vocabulary of any size takes more passes and no larger
filters. In a pass every word probes its own edits against the shards of their lengths: all deletions, and replacements
by code points above the one replaced. That is enough, as being near works both ways. Edits that pass a filter are
joined with the vocabulary, which removes false positives, so the result is exact.

Edits are hashed without being written out: a word's hash is the exclusive or of one number for each place and code
point, so a replacement changes two of them, and a deletion joins a running value from the left with
one from the right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import ascii_lower, join_counted, stored
from slotframe.llm.shingles import M1, mix64

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
TYPO = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
WORD_BITS, PROBES = 16, 6
BLOCK_WORDS = 8
"""64-bit words in a block of a filter; all bits of one word of the vocabulary lie in one block."""
SEGMENT_BLOCKS = 1024
FILTER_BYTES = 32 << 20
EDITS = 1 << 21
"""Edits that a task hashes at a time."""
JUMPS = 64


def words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z alone), with the seeded typos of the contract, counted over all texts."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select("id", ascii_lower(F.col("run")).alias("run"))
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", mark.alias("mark"), (mark % F.length("run")).cast("int").alias("at"))
    word = F.when(F.col("mark") % TYPO == 0, F.concat(F.substring("run", F.lit(1), F.col("at")), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return rows.groupBy(word.alias("word")).agg(F.count("*").alias("n"))


# ---- hashes -----------------------------------------------------------------

def place_numbers(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A number for each place (from 0) and code point."""
    with np.errstate(over="ignore"):
        return mix64((places.astype(np.uint64) << np.uint64(8) | letters.astype(np.uint64)) * M1 + M1)


def matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of code points; all of them are below 256."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def hashes(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(letters), np.uint64)
    step = max(1, EDITS // max(1, len(letters)))
    for at in range(0, letters.shape[1], step):
        cut = letters[:, at: at + step]
        out ^= np.bitwise_xor.reduce(place_numbers(np.arange(at, at + cut.shape[1])[None, :], cut), 1)
    return out


def deletions(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, hash) of all words with one code point less; of equal neighbours only the last is deleted."""
    rows, length = letters.shape
    step = max(1, EDITS // max(1, rows))
    own = np.zeros(rows, np.uint64)  # places before the deleted one as they are
    moved = np.zeros(rows, np.uint64)  # places behind it, each one place to the left
    for at in range(1, length, step):
        cut = letters[:, at: at + step]
        moved ^= np.bitwise_xor.reduce(place_numbers(np.arange(at - 1, at - 1 + cut.shape[1])[None, :], cut), 1)
    for at in range(0, length, step):
        cut = letters[:, at: at + step]
        place = np.arange(at, at + cut.shape[1])[None, :]
        left = np.bitwise_xor.accumulate(place_numbers(place, cut), 1)
        shifted = place_numbers(np.maximum(place - 1, 0), cut)
        shifted[:, place[0] == 0] = 0  # the first place never moves
        gone = np.bitwise_xor.accumulate(shifted, 1)
        before = np.hstack([np.zeros((rows, 1), np.uint64), left[:, :-1]])
        found = own[:, None] ^ before ^ moved[:, None] ^ gone
        following = letters[:, at + 1: at + 1 + cut.shape[1]]
        keep = np.ones(cut.shape, bool)
        keep[:, : following.shape[1]] = cut[:, : following.shape[1]] != following
        r, p = np.nonzero(keep)
        yield r, p + at, found[r, p]
        own ^= left[:, -1]
        moved ^= gone[:, -1]


def replacements(letters: np.ndarray, whole: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, new code point, hash) of all words with one code point replaced by a larger one of the alphabet."""
    rows, length = letters.shape
    step = max(1, EDITS // max(1, rows * len(alphabet)))
    for at in range(0, length, step):
        cut = letters[:, at: at + step]
        place = np.arange(at, at + cut.shape[1])
        base = whole[:, None] ^ place_numbers(place[None, :], cut)
        new = place_numbers(place[:, None], alphabet[None, :])
        r, p, a = np.nonzero(cut[:, :, None] < alphabet[None, None, :])
        yield r, p + at, alphabet[a], base[r, p] ^ new[p, a]


# ---- filters ----------------------------------------------------------------

@dataclass(frozen=True)
class Shard:
    """Words of one length, of all ``parts`` hash parts the ``part``-th; its filter has ``blocks`` blocks."""
    length: int
    part: int
    parts: int
    blocks: int

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        return hashed % np.uint64(self.parts) == self.part if self.parts > 1 else np.ones(len(hashed), bool)


def plan(sizes: dict[int, int], budget: int) -> list[list[Shard]]:
    """Shards for the number of words of each length, in passes whose filters have at most ``budget`` bytes."""
    block_bits = 64 * BLOCK_WORDS
    room = max(1, budget * 8 // block_bits)
    passes: list[list[Shard]] = [[]]
    used = 0
    for length in sorted(sizes):
        blocks = max(1, -(-sizes[length] * WORD_BITS // block_bits))
        parts = -(-blocks // room)
        for part in range(parts):
            shard = Shard(length, part, parts, -(-blocks // parts))
            if used + shard.blocks > room and passes[-1]:
                passes.append([])
                used = 0
            passes[-1].append(shard)
            used += shard.blocks
    return passes


def block_of(hashed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix64(hashed) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def bit_of(hashed: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of the i-th probe within a block."""
    bit = (mix64(hashed ^ M1) >> np.uint64(9 * i)) & np.uint64(64 * BLOCK_WORDS - 1)
    return bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))


def keyed(shards: list[Shard]) -> object:
    """Words to the segment of the filter that holds them: shard number, segment, hash."""
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(shards):
        by_length.setdefault(s.length, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, words, _ in by_size(batches):
            hashed = hashes(matrix(words))
            for i in by_length.get(length, []):
                own = hashed[shards[i].holds(hashed)]
                segment = (block_of(own, shards[i].blocks) // np.uint64(SEGMENT_BLOCKS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(segment), pa.array(own.view(np.int64))],
                                                 ["shard", "segment", "hash"])
    return run


def segment_bits(shards: list[Shard]) -> object:
    """The words of one segment of a filter to its bits."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = shards[key[0].as_py()], key[1].as_py()
        first = segment * SEGMENT_BLOCKS
        bits = np.zeros((min(SEGMENT_BLOCKS, shard.blocks - first), BLOCK_WORDS), np.uint64)
        for batch in batches:
            hashed = batch.column("hash").to_numpy().view(np.uint64)
            block = block_of(hashed, shard.blocks).astype(np.int64) - first
            for i in range(PROBES):
                word, bit = bit_of(hashed, i)
                np.bitwise_or.at(bits, (block, word.astype(np.int64)), bit)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([segment], pa.int64()), pa.array([bits.tobytes()])],
                                         ["shard", "segment", "bits"])
    return run


def filters(vocabulary: DataFrame, shards: list[Shard]) -> list[np.ndarray]:
    """The filters of one pass. What reaches the driver is the filters, whose size the plan has bounded."""
    rows = vocabulary.select("letters", "n").mapInArrow(keyed(shards), "shard int, segment long, hash long")
    rows = rows.groupBy("shard", "segment").applyInArrow(segment_bits(shards), "shard int, segment long, bits binary").collect()
    out = [np.zeros((s.blocks, BLOCK_WORDS), np.uint64) for s in shards]
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint64).reshape(-1, BLOCK_WORDS)
        out[r["shard"]][r["segment"] * SEGMENT_BLOCKS: r["segment"] * SEGMENT_BLOCKS + len(bits)] = bits
    return out


def passing(shard: Shard, bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    left = np.flatnonzero(shard.holds(hashed))
    block = block_of(hashed[left], shard.blocks).astype(np.int64)
    for i in range(PROBES):
        word, bit = bit_of(hashed[left], i)
        ok = (bits[block, word.astype(np.int64)] & bit) != 0
        left, block = left[ok], block[ok]
    return left


def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Rows (letters, n) in groups of one length."""
    for batch in batches:
        words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            step = max(1, EDITS // (16 * length))
            for i in range(0, len(at), step):
                yield length, [words[k] for k in at[i: i + step]], n[at[i: i + step]]


def probe(shards: list[Shard], held: object, alphabet: np.ndarray) -> object:
    """Words to those of their edits that a filter of this pass may hold: the word, its n, the edit."""
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(shards):
        by_length.setdefault(s.length, []).append(i)

    def batch_of(words: list[bytes], n: np.ndarray, rows: np.ndarray, edits: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([words[r].decode("latin-1") for r in rows], pa.string()), pa.array(n[rows]),
             pa.array([e.decode("latin-1") for e in edits], pa.string())], ["word", "n", "edit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for length, words, n in by_size(batches):
            letters = matrix(words)
            if length - 1 in by_length:
                for r, p, hashed in deletions(letters):
                    for i in by_length[length - 1]:
                        ok = passing(shards[i], bits[i], hashed)
                        yield batch_of(words, n, r[ok], [words[a][:b] + words[a][b + 1:] for a, b in zip(r[ok], p[ok])])
            if length in by_length:
                for r, p, c, hashed in replacements(letters, hashes(letters), alphabet):
                    for i in by_length[length]:
                        ok = passing(shards[i], bits[i], hashed)
                        yield batch_of(words, n, r[ok], [words[a][:b] + bytes([x]) + words[a][b + 1:] for a, b, x in zip(r[ok], p[ok], c[ok])])
    return run


# ---- groups -----------------------------------------------------------------

def near_words(vocabulary: DataFrame, budget: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): every two words of the vocabulary that differ by one inserted, deleted or replaced code
    point, both ways. ``vocabulary`` has (word, letters, n); it is read several times and should be a written table."""
    sizes = {r["length"]: r["words"] for r in vocabulary.groupBy(F.length("letters").alias("length")).agg(F.count("*").alias("words"))
             .orderBy("length").collect()}
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # 256 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    spark, found = vocabulary.sparkSession, None
    spread = vocabulary.select("letters", "n").repartition(F.xxhash64("letters"))
    for shards in plan(sizes, budget):
        if not shards:
            continue
        held = spark.sparkContext.broadcast(filters(vocabulary, shards))
        own = stored(spread.mapInArrow(probe(shards, held, alphabet), "word string, n long, edit string"), "edits")
        held.unpersist()
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
    one = found.join(known, "edit").select("word", "n", F.col("edit").alias("other"), "other_n")
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last word that following forms leads to. Each step doubles the way; a form has at
    least twice its word's n, so ways are short and never closed."""
    links = stored(forms.select("word", F.col("form").alias("at")), "roots")
    for _ in range(JUMPS):
        into = links.groupBy("at").agg(F.count("*").alias("rows"))
        onward = links.select(F.col("word").alias("at"), F.col("at").alias("next")).join(into, "at")
        moved = join_counted(links, onward, "at", "rows", links.count(), F.col("word"))
        links = stored(moved.select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", F.col("at").alias("root"))
        links = links.select("word", "at")
    raise RuntimeError("forms did not settle")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = FILTER_BYTES) -> DataFrame:
    """One row for each word of at least 5 code points that occurs 3 times or more: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where 97 divides the CRC-32 of
    ``id:run``, one code point, given by it too, is missing. n_near counts the words that differ in one code point. The form is
    the most frequent of them (ties: smallest in code-point order) if it occurs at least twice as often; the root is the last form
    of the chain. Without a form: null, the word itself, null. Null texts have no words; a row without
    an id has an empty one; repeated rows count each. Empty input: no rows.
    """
    words = words_of(docs, id_col, text_col).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    # every letter fits one byte, so words become bytes once
    vocabulary = stored(words.select("word", F.encode("word", "ISO-8859-1").alias("letters"), "n"), "vocabulary")
    near = near_words(vocabulary, budget).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    rows = vocabulary.select("word", "n").join(near, "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    roots = roots_of(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
