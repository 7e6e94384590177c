"""Quality of a text by compression: dictionaries of good and bad texts, and what they save.

Two zstandard dictionaries are built from a bounded sample of labelled texts, one of good and one of
bad ones. A text that compresses better with the good dictionary resembles good text; the difference
of the two sizes, divided by the text's size, is the signal. A logistic curve of the signal alone, fitted on
another bounded sample of labelled texts, turns it into the probability of label 1. Long texts
are compressed in pieces of PIECE bytes, each anew with the dictionary, so that the size of a
text does not dilute what the dictionaries know; all pieces count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import slices

SAMPLE = 6000
"""Labelled texts of each class that are drawn, at most about so many; half build dictionaries, half calibrate."""
SAMPLE_BYTES = 24_000_000
DICTIONARY = 262_144
PIECE = 2048
LEVEL = 3
SCHEMA = "score double, signal double"
FEATURES = 2
FEW = 16
"""Texts of each class that are drawn at least, if there are so many, however long they are."""


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


class Gauge:
    """Compressed sizes of a text with either dictionary, by pieces."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        def packer(data: bytes) -> zstandard.ZstdCompressor:
            words = zstandard.ZstdCompressionDict(data) if data else None
            if words:
                words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False)
        self.packers = [packer(good), packer(bad)]

    def signal(self, text: str | None) -> float:
        """What the good dictionary saves against the bad one, for each byte of the text."""
        raw = (text or "").encode("utf-8", "replace")
        good = bad = 0
        for at in range(0, len(raw), PIECE):
            piece = raw[at: at + PIECE]
            good += len(self.packers[0].compress(piece))
            bad += len(self.packers[1].compress(piece))
        return (bad - good) / len(raw) if raw else 0.0

    def features(self, texts: list[str | None]) -> np.ndarray:
        return np.array([[1.0, self.signal(t)] for t in texts]).reshape(-1, FEATURES)


def dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts' pieces; of their raw bytes where there are too few to train on."""
    pieces = [raw[at: at + PIECE] for t in texts for raw in [t.encode("utf-8", "replace")] for at in range(0, len(raw), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small ridge; the same data give the same weights."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on about ``sample`` texts and ``sample_bytes`` bytes of each class, chosen by a hash of the id, but on FEW
    texts of each at least if there are so many; of a text that alone would fill a good part of ``sample_bytes`` the fit sees
    the beginning. Null labels, ids and texts take no part; repeated labels of an id count once where they agree and not
    at all where they do not. Where one class has no text, every score is the other's share of the labels, 0 or 1; without labels 0.5."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(F.col(label_col).cast("int")).alias("_y"), F.max(F.col(label_col).cast("int")).alias("_most")).where("_y = _most and _y in (0, 1)")
    sizes = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_bytes"))
    known = sizes.join(marks, "_id")
    held = {r["_y"]: r for r in known.groupBy("_y").agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")).collect()}
    if not held:
        return Model(b"", b"", (0.0,) * FEATURES, 0.5)
    prior = (held[1]["n"] if 1 in held else 0) / sum(r["n"] for r in held.values())
    if len(held) < 2:
        return Model(b"", b"", (0.0,) * FEATURES, prior)
    # Ids with texts in the order of their hash, as many of each class as its bytes allow.
    drawn = [known.where(F.col("_y") == y).select("_id", "_y", F.xxhash64("_id", F.lit(72)).alias("_u")).distinct().orderBy("_u", "_id").limit(
        max(FEW, int(min(1.0, sample / r["n"], sample_bytes / max(1, r["bytes"])) * r["n"]))) for y, r in held.items()]
    chosen = drawn[0].unionByName(drawn[1])
    part = F.substring(F.col(text_col), 1, max(PIECE, sample_bytes // FEW))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), part.alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y", "_u").agg(F.min("_text").alias("_text"))  # one of each id
    pdf: pd.DataFrame = texts.toPandas().sort_values(["_y", "_u", "_id", "_text"], ignore_index=True)
    # Of each class every second text builds its dictionary and the others calibrate; a single text does both.
    turn = pdf.groupby("_y").cumcount()
    good, bad = [dictionary(pdf.loc[(pdf["_y"] == y) & (turn % 2 == 0), "_text"].tolist()) for y in (1, 0)]
    rest = pdf[turn % 2 == 1]
    if rest["_y"].nunique() < 2:
        rest = pdf
    x, y = Gauge(good, bad).features(rest["_text"].tolist()), rest["_y"].to_numpy(float)
    weights = logistic(x, y)
    # The sample may hold the classes in other shares than the labels do; the constant makes up for that.
    share = y.mean()
    weights[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(good, bad, tuple(weights.tolist()), prior)


def score_batches(model: Model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge, weights = Gauge(model.good, model.bad), np.array(model.weights)
        for batch in slices(batches, -1):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if any(model.weights) and texts:
                x = gauge.features(texts)
                score, signal = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), x[:, 1]
            else:
                score, signal = np.full(len(texts), model.prior), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array(signal)],
                                             [*batch.schema.names[:-1], "score", "signal"])
    return run


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns in ``keep``, score (0 to 1) and signal.

    Null and empty texts have the signal 0 and the score that the curve gives there. Whole texts count.
    """
    own = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(score_batches(model), ", ".join(filter(None, (kinds, SCHEMA))))
