"""Fill-in-the-middle over texts stored as seekable compressed frames.

A text is kept as a list of independent zstandard frames with, for each, its size and how many units (lines), code
points and bytes lie before it. To cut a text after its u-th unit, the counts name the frame in which that unit ends, and only that frame is
decompressed. The transformed text is written as frames in the same way, from slices of the ordered input
frames, so memory follows the size of a frame and not that of a text. Digests and the way back stream the frames in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import slices

FRAME_BYTES = 1 << 18
LEVEL = 3
# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FRAMES = "frames array<struct<payload: binary, bytes: long, units: long, chars: long>>"
KIND = pa.list_(pa.struct([("payload", pa.binary()), ("bytes", pa.int64()), ("units", pa.int64()), ("chars", pa.int64())]))


class Cut(NamedTuple):
    """A place in a text: the bytes and code points before it."""
    at: int
    chars: int


def chars_in(raw: bytes | memoryview) -> int:
    """Code points that begin in the bytes."""
    raw = bytes(raw)
    return len(raw) - sum(map(raw.count, CONTINUED)) if not raw.isascii() else len(raw)


CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]


class Writer:
    """Packs a stream of bytes into frames; counts are those of all frames before."""

    def __init__(self, size: int):
        self.size, self.held, self.frames = size, bytearray(), []
        self.bytes = self.units = self.chars = 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, raw: bytes | memoryview) -> None:
        view = memoryview(raw)
        while len(view):
            take = self.size - len(self.held)
            self.held += view[:take]
            view = view[take:]
            if len(self.held) == self.size:
                self.flush()

    def flush(self) -> None:
        if self.held:
            raw = bytes(self.held)
            self.frames.append({"payload": self.packer.compress(raw), "bytes": self.bytes, "units": self.units, "chars": self.chars})
            self.bytes, self.units, self.chars = self.bytes + len(raw), self.units + raw.count(b"\n"), self.chars + chars_in(raw)
            self.held.clear()

    def done(self) -> list[dict]:
        self.flush()
        return self.frames


class Reader:
    """Random access to framed text."""

    def __init__(self, frames: list[dict], total: int):
        self.frames, self.total = frames, total
        self.unpacker = zstandard.ZstdDecompressor()

    def raw(self, i: int) -> bytes:
        return self.unpacker.decompress(self.frames[i]["payload"])

    def after_unit(self, u: int, chars: int) -> Cut:
        """The place behind the u-th line; ``chars`` are the code points of the whole text, which ends the last line."""
        if u <= 0:
            return Cut(0, 0)
        i = bisect_left([f["units"] for f in self.frames], u) - 1  # the last frame with fewer line ends before it
        raw, left, end = self.raw(i), u - self.frames[i]["units"], 0
        while left and (found := raw.find(b"\n", end)) >= 0:
            end, left = found + 1, left - 1
        if left:
            return Cut(self.total, chars)
        return Cut(self.frames[i]["bytes"] + end, self.frames[i]["chars"] + chars_in(raw[:end]))

    def part(self, begin: int, end: int) -> Iterator[memoryview]:
        """The bytes from ``begin`` to ``end``, a frame at a time."""
        if begin >= end:
            return
        starts = [f["bytes"] for f in self.frames]
        for i in range(bisect_left(starts, begin + 1) - 1, bisect_left(starts, end)):
            yield memoryview(self.raw(i))[max(0, begin - starts[i]): end - starts[i]]


def pack(size: int) -> object:
    """Rows (key, text) to frames, sizes, and whether a mark occurs in the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                writer = Writer(size)
                writer.add(raw)
                frames = writer.done()
                rows.append((frames, writer.units + (raw[-1:] not in (b"", b"\n")), writer.chars, writer.bytes,
                             any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE))))
            frames, n, chars, total, marked = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(frames, KIND), pa.array(n, pa.int64()), pa.array(chars, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(marked, pa.bool_())], ["key", "frames", "n", "chars", "bytes", "marked"])
    return run


def rearranged(size: int) -> object:
    """Rows (key, frames, n, chars, bytes, form, first, second) to the frames and bytes of the output and the sizes of its parts."""
    def one(frames: list[dict], chars: int, total: int, form: str, first: int, second: int) -> tuple:
        if form == PLAIN:
            return frames, total, None, None
        text, writer = Reader(frames, total), Writer(size)
        a, b = text.after_unit(first, chars), text.after_unit(second, chars)
        prefix, middle, suffix = (0, a.at), (a.at, b.at), (b.at, total)
        order = [(PREFIX, prefix), (SUFFIX, suffix)]
        for mark, span in [*(order if form == PSM else order[::-1]), (MIDDLE, middle)]:
            writer.add(mark)
            for piece in text.part(*span):
                writer.add(piece)
        return writer.done(), writer.bytes, a.chars, b.chars - a.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [one(*(batch.column(i)[at].as_py() for i in (1, 3, 4, 5, 6, 7))) for at in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(5), pa.array([f[0] for f in found], KIND),
                 *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]],
                ["key", "n", "form", "frames", "bytes", "prefix_chars", "middle_chars"])
    return run


def bounded(batches: Iterator[pa.RecordBatch], limit: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts had about ``limit`` bytes, or one row; the column ``bytes`` says how many."""
    for batch in batches:
        begin, held = 0, 0
        for at, size in enumerate(batch.column("bytes").to_pylist()):
            if held and held + size > limit:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        yield batch.slice(begin)


def mark_places(text: Reader) -> dict[bytes, int]:
    """Where the first of each mark lies, also across frames."""
    places, tail, before = {}, b"", 0
    for i in range(len(text.frames)):
        seen = tail + text.raw(i)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in places and (found := seen.find(mark)) >= 0:
                places[mark] = before - len(tail) + found
        before += len(seen) - len(tail)
        tail = seen[-2:]
    return places


def restored(text: Reader, form: str) -> Iterator[memoryview]:
    """The bytes of the text before it was transformed, in order."""
    if form == PLAIN:
        yield from text.part(0, text.total)
        return
    places = mark_places(text)
    ends = sorted(places.values()) + [text.total]
    for mark in (PREFIX, MIDDLE, SUFFIX):
        begin = places[mark]
        yield from text.part(begin + len(mark), ends[ends.index(begin) + 1])


def digest(pieces: Iterator[memoryview]) -> str:
    sha = hashlib.sha256()
    for piece in pieces:
        sha.update(piece)
    return sha.hexdigest()


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transformed rows with digests of the output and of the text restored from it instead of frames."""
    for batch in batches:
        out, back = [], []
        for at in range(batch.num_rows):
            frames, total, form = [batch.column(name)[at].as_py() for name in ("frames", "bytes", "form")]
            text = Reader(frames, total)
            out.append(digest(text.part(0, total)))
            back.append(digest(restored(text, form)))
        kept = [n for n in batch.schema.names if n != "frames"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(out, pa.string()), pa.array(back, pa.string())],
                                         [*kept, "output_sha256", "restored_sha256"])


def unframed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [b"".join(map(bytes, Reader(f, t).part(0, t))) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["key", "text"])


def _carried(df: DataFrame, given: list[str], fn: object, schema: str) -> DataFrame:
    """The rows of ``df`` mapped; its column ``key`` (any type) goes along."""
    key = df.schema["key"].dataType.simpleString()
    return df.select("key", *given).mapInArrow(fn, f"key {key}, {schema}")


def frame_texts(docs: DataFrame, key: Column, text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row for each row of ``docs``: key, frames, n (lines), chars, bytes, marked (a mark occurs in the text). A null
    text is an empty one, and empty texts have no frames."""
    rows = docs.select(key.alias("key"), F.col(text_col).alias("_t"))
    return _carried(rows, ["_t"], pack(frame_bytes), f"{FRAMES}, n long, chars long, bytes long, marked boolean")


def seeded_numbers(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``; a null id counts as no digits."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(framed: DataFrame, id_col: Column, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Framed texts (:func:`frame_texts`) to their fill-in-the-middle form: key, n, form, frames and bytes of the output,
    prefix_chars, middle_chars.

    ``id_col`` is an expression on ``key``. The prefix ends after one of n + 1 places between lines, the
    middle after another, both drawn from the id. ``rate`` percent of the texts are transformed, ``spm_rate`` percent of
    these with the suffix first. Empty texts and texts that hold a mark stay plain, with null sizes.
    """
    h1, h2, h3, h4 = seeded_numbers(id_col, seed)
    places = F.col("n") + 1
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate), PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM)
    rows = framed.select("key", "frames", "n", "chars", "bytes", form.alias("form"),
                         F.least(h1 % places, h2 % places).alias("first"), F.greatest(h1 % places, h2 % places).alias("second"))
    return _carried(rows, rows.columns[1:], rearranged(frame_bytes), f"n long, form string, {FRAMES}, bytes long, prefix_chars long, middle_chars long")


def digests(transformed: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with output_sha256 and restored_sha256 instead of frames, from the frames and the form alone."""
    return _carried(transformed, ["n", "form", "frames", "bytes", "prefix_chars", "middle_chars"], digested,
                    "n long, form string, bytes long, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def read_texts(framed: DataFrame) -> DataFrame:
    """key and text of framed rows."""
    return _carried(framed, ["frames", "bytes"], unframed, "text string")
