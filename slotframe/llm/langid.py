"""Language of a text as a mixture: expectation-maximisation over n-gram likelihoods.

A model holds, for each language, smoothed frequencies of hashed character n-grams of lengths 1 to
ORDER, fitted on a bounded sample of labelled texts. A document's distinct words are its units: the
likelihood of a word under a language is the product over its n-grams. Expectation-maximisation
gives the proportions of the languages that make the words likeliest; the set of languages grows
one by one as long as its log-likelihood gains more than a penalty for one more proportion. The
prediction is the language with the largest proportion in the chosen set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import slices

BUCKETS = 1 << 16
ORDER = 3
SAMPLE = 4000
"""Labelled texts for each language that the model is fitted on, at most about so many."""
SAMPLE_BYTES = 8_000_000
"""UTF-8 bytes of them for each language, at most about so many."""
FEW = 16
"""Texts for each language at least, if there are so many, whatever their size."""
SLICE = 1_000_000
"""Bytes of texts whose words are weighed together, at most about so many, or one text."""
PENALTY = 3.0
"""What one more language must gain, times 1 + log(words)."""
FLOOR = -8.0
TRIAL_ROUNDS, ROUNDS = 8, 20
UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, languages array<string>, proportions array<double>, gain double"


@dataclass(frozen=True)
class Model:
    """Log-frequencies by n-gram bucket (rows) and language (columns)."""

    languages: tuple[str, ...]
    logs: np.ndarray


LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def split_words(text: str) -> list[str]:
    """Runs of letters, in lower case, with apostrophes inside. Numerals that count as word characters alone are none."""
    found = LETTERS.findall(text.lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of all words, each word between two marks, and where each word's begin."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    starts = ends - np.diff(ends, prepend=0)
    word = np.repeat(np.arange(len(words)), ends - starts)
    found, owner = [], []
    value = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            value = value[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)
            mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = word[: len(value)] == word[n - 1:]
            found.append((mixed >> np.uint64(64 - 16))[inside].astype(np.int64))
            owner.append(word[: len(value)][inside])
    bucket, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])[:-1]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words := split_words(text):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams(words)[0], minlength=BUCKETS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                                         ["lang", "bucket", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_by: Column | None = None,
        sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits the model on about ``sample`` texts and ``sample_bytes`` bytes of each language, chosen by a hash of
    ``order_by`` (of the text by default), so reruns agree, but on FEW texts of each at least. Null texts, texts without a letter and null
    languages take no part."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                       F.pmod(F.xxhash64(order_by if order_by is not None else F.col(text_col), F.lit(71)), F.lit(1 << 30)).alias("_u"))
    held = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not held:
        return Model((), np.zeros((BUCKETS, 0)))
    share = {r["lang"]: min(1.0, sample / r["n"], sample_bytes / max(1, r["bytes"])) for r in held}
    # However long its texts are, each language gives at least those FEW that come first.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_u"))
    first = rows.select("lang", "_u").withColumn("_turn", turn).where(F.col("_turn") <= FEW).groupBy("lang").agg(F.max("_u").alias("u")).collect()
    least = {r["lang"]: r["u"] + 1 for r in first}
    limits = labelled.sparkSession.createDataFrame(
        [(k, max(least[k], int(v * (1 << 30)))) for k, v in share.items()], "lang string, _limit long")
    chosen = rows.join(F.broadcast(limits), "lang").where(F.col("_u") < F.col("_limit")).select("lang", "text")
    counts = chosen.mapInArrow(count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    pdf = counts.toPandas()
    languages = tuple(sorted(pdf["lang"].unique()))
    table = np.zeros((BUCKETS, len(languages)))
    table[pdf["bucket"], [languages.index(x) for x in pdf["lang"]]] = pdf["n"]
    # Witten-Bell-like: seen mass, and an even share of the rest for what was never seen.
    seen, total = (table > 0).sum(0), table.sum(0)
    free = seen / (total + seen)
    probability = (1 - free) * table / np.maximum(total, 1) + free / BUCKETS
    return Model(languages, np.log(probability) if languages else probability)


def expectation_maximisation(weight: np.ndarray, counts: np.ndarray, start: np.ndarray, share: np.ndarray,
                             rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihoods of many documents at once.

    ``weight``: for each language, the likelihood of each unit, the best language of a unit at 1; ``start``: where
    each document's units begin; ``share``: for each language, the shares to start from, 0 for those left out.
    """
    size = np.diff(np.append(start, len(counts)))
    total = np.add.reduceat(counts, start)
    for _ in range(rounds):
        part = weight * np.repeat(share, size, axis=1)
        part *= counts / part.sum(0)
        share = np.add.reduceat(part, start, axis=1) / total
    mass = (weight * np.repeat(share, size, axis=1)).sum(0)
    return share, np.add.reduceat(counts * np.log(mass), start)


def pick(start: np.ndarray, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the units of some documents, and where each of these begins among them."""
    begin = np.concatenate([[0], np.cumsum(size[docs])[:-1]]).astype(np.int64)
    return np.repeat(start[docs] - begin, size[docs]) + np.arange(size[docs].sum()), begin


def choose(logs: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents by languages) of the chosen sets, and what each set gains over its best single language.

    ``logs``: languages by units. A unit that a language does not explain counts FLOOR against it, however odd it
    is, so stray words bring no language in. Each step tries the language that would gain most if every
    unit could take its best one.
    """
    n, k = len(start), len(logs)
    logs = np.maximum(logs, FLOOR)
    weight = np.exp(logs)
    size = np.diff(np.append(start, len(counts)))
    weighed = logs * counts
    single = np.add.reduceat(weighed, start, axis=1)
    first = single.argmax(0)
    share = np.zeros((k, n))
    share[first, np.arange(n)] = 1
    alone = single.max(0)
    best, cover = alone.copy(), weighed[np.repeat(first, size), np.arange(len(counts))]
    price = PENALTY * (1 + np.log(np.maximum(np.add.reduceat(counts, start), 2)))
    growing = np.arange(n)
    for _ in range(k - 1):
        units, begin = pick(start, size, growing)
        reach = np.add.reduceat(np.maximum(weighed[:, units], cover[units]), begin, axis=1) - best[growing]
        reach[share[:, growing] > 0] = -np.inf
        top = reach.argmax(0)
        likely = reach[top, np.arange(len(growing))] > price[growing]
        growing, top = growing[likely], top[likely]
        if not len(growing):
            break
        units, begin = pick(start, size, growing)
        trial = (share[:, growing] > 0) * 1.0
        trial[top, np.arange(len(growing))] = 1
        found, value = expectation_maximisation(weight[:, units], counts[units], begin, trial / trial.sum(0), TRIAL_ROUNDS)
        ok = value - best[growing] > price[growing]
        growing, top = growing[ok], top[ok]
        if not len(growing):
            break
        units, begin = pick(start, size, growing)
        found, value = expectation_maximisation(weight[:, units], counts[units], begin, found[:, ok], ROUNDS)
        share[:, growing], best[growing] = found, value
        cover[units] = np.maximum(cover[units], weighed[np.repeat(top, size[growing]), units])
    return share.T, best - alone


def identify_batches(model: Model, text_at: int = -1, kept: int = -1) -> object:
    """The first ``kept`` columns of a batch with what is found in the texts of column ``text_at``."""
    k = len(model.languages)
    by_language = np.ascontiguousarray(model.logs.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at, SLICE):
            texts = batch.column(text_at).to_pylist()
            rows: list[tuple] = [(UNDETERMINED, 0.0, [], [], 0.0)] * len(texts)
            words, counts, sizes, docs = [], [], [], []
            seen: dict[str, int] = {}
            for i, text in enumerate(texts):
                if own := Counter(split_words(text)) if text and k else None:
                    words.extend(seen.setdefault(w, len(seen)) for w in own)
                    counts.extend(own.values())
                    sizes.append(len(own))
                    docs.append(i)
            if docs:
                bucket, begin = grams(list(seen))
                own_logs = np.stack([np.add.reduceat(column[bucket], begin) for column in by_language])
                logs = (own_logs - own_logs.max(0))[:, words]
                start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                share, gain = choose(logs, np.array(counts, float), start)
                for d, i in enumerate(docs):
                    order = np.argsort(-share[d], kind="stable")
                    order = order[share[d][order] > 0]
                    rows[i] = (model.languages[order[0]], float(min(1.0, share[d][order[0]])), [model.languages[x] for x in order],
                               share[d][order].tolist(), float(gain[d]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                [*batch.schema.names[:kept], "lang_pred", "score", "languages", "proportions", "gain"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns in ``keep``, lang_pred, score (the proportion of the predicted
    language), languages and proportions (the chosen set, largest first) and gain (log-likelihood over the best
    single language).

    Null texts and texts without a letter, and all texts under an empty model, are "und" with score 0 and no
    languages. Ties go to the language that sorts first. Whole texts are read; the work of a task is bounded
    by an Arrow batch. Columns named like the results are not carried along.
    """
    # a text that is kept goes to Python once
    own = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:len(keep)])
    return own.mapInArrow(identify_batches(model, text_at, len(keep)), ", ".join(filter(None, (kinds, SCHEMA))))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows kept from fitting: those whose crc32(id as text) has this remainder. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
