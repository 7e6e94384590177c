"""WARC archives of captured pages, with revisits, and a global capture index merged from sorted runs.

Records are whole WARC/1.1 records built by column functions and written by Spark's own text sink as
gzip files, so any file system works and a lost task is written again. They are read back line by
line, each file in order, by a parser that holds one record at a time.

The index is an external merge. Each reading task sorts its captures by URL key and timestamp: a run. The
runs are split at common key boundaries, and each range merges its pieces of all runs with a loser
tree, which finds the next capture with one comparison per level. The ranges one after another hold
every URL's captures in order, however many captures a URL has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotframe.llm.common import ascii_lower, join_counted, stored
from slotframe.session import new_path

LEAST_PAYLOAD = 1000
"""Payloads below this many bytes are stored each time."""
RANGE_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("page_id long, url string, captured string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, intact boolean, archive string, offset long")
CRLF = "\r\n"


def field(name: str, value: Column) -> Column:
    """A header line, none for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   captured: Column | None = None, least: int = LEAST_PAYLOAD) -> str:
    """Writes a record for each row and gives the folder of the archives.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is a response, the others are
    revisits that refer to it; rows that repeat its id are responses too, and a null id is smaller than any.
    All smaller payloads, and the empty payload that stands for a null, are responses. Line breaks in URLs are
    percent-encoded; a null URL or id leaves its header out and is null when read. ``captured`` is a timestamp,
    the start of 1970 where null or not given.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col), F.lit(""))
    when = F.coalesce(captured if captured is not None else F.lit(None).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), when.alias("_when"),
                        body.alias("_body"), F.octet_length(body).alias("_bytes"), F.sha1(body.cast("binary")).alias("_digest"))
    rows = rows.withColumn("_key", F.when(F.col("_bytes") >= least, F.col("_digest")))
    groups = rows.where("_key is not null").groupBy("_key").agg(F.max("_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    groups = stored(groups, "payloads")
    total = groups.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    rows = join_counted(rows, groups, "_key", "_rows", total, F.struct("_id", "_url"))
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes"), F.lit(CRLF * 2))
    url = F.replace(F.replace("_url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("_id"), F.lit(">"))), field("WARC-Target-URI", url),
        field("WARC-Date", F.date_format("_when", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(again, F.concat(field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first"), F.lit(">"))),
                               F.lit(f"WARC-Profile: {PROFILE}{CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(head) + F.when(again, 0).otherwise(F.col("_bytes"))), F.lit(CRLF),
        head, F.when(again, "").otherwise(F.col("_body")),
        F.lit("\r\n\r"))  # the sink adds the last line feed
    path = new_path(spark, "warc")
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


class Records:
    """Puts lines together to records: give it lines, it gives (start, headers, block) when one is whole."""

    def __init__(self) -> None:
        self.at = self.start = 0
        self.headers: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.missing = 0

    def add(self, line: bytes) -> tuple[int, dict[str, str], bytes] | None:
        begin, self.at = self.at, self.at + len(line) + 1
        if self.missing:
            self.parts.append(line)
            self.missing -= len(line) + 1
            if self.missing > 0:
                return None
            if self.missing < 0:
                raise ValueError(f"record at byte {self.start} has another length than it says")
            headers, block = self.headers, b"\n".join([*self.parts, b""])[:-4]
            self.headers, self.parts, self.missing = None, [], 0
            return self.start, headers, block
        text = line.rstrip(b"\r")
        if self.headers is None:
            if text.startswith(b"WARC/"):
                self.headers, self.start = {}, begin
            elif text:
                raise ValueError(f"no record at byte {begin}")
        elif text:
            name, _, value = text.partition(b":")
            self.headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        else:
            self.missing = int(self.headers["content-length"]) + 4
        return None


def number(urn: str | None) -> int | None:
    return int(urn.rpartition(":")[2].rstrip(">")) if urn else None


def capture(archive: str, start: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record. A response's payload is digested anew; a revisit's length is what its own HTTP header says."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if revisit:
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    else:
        size = len(payload)
    digest = said if revisit else hashlib.sha1(payload).hexdigest()
    return (number(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-date"), headers["warc-type"], size,
            digest, number(headers.get("warc-refers-to")), digest == said, archive, start)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (archive, value), in the order of the files, to index entries."""
    names = [f.split()[0] for f in CAPTURE.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in CAPTURE.split(", ")]
    archive, records, rows = None, Records(), []
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if name != archive:
                archive, records = name, Records()
            if found := records.add(line):
                rows.append(capture(archive, *found))
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records in the archives. ``intact`` tells whether a payload has the digest its record states."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("archive"), "value")
    return lines.mapInArrow(parse, CAPTURE)


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then the rest: captures of a site sort together."""
    rest = F.regexp_extract(url, r"(?s)^(?:[^/?#]*://)?(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    return F.coalesce(F.when(url != "", key), F.lit(""))


class LoserTree:
    """Merges sorted lists. Each inner node keeps the loser of its two sides, so after a winner is taken only
    the matches on its way to the root are played again."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, n = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, n)
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0

    def before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position), in order."""
        n = len(self.runs)
        while n and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + n) // 2
            while node:
                if self.before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, url_key, captured, page_id, ...) of one key range, run after run, to one sorted sequence."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(),
                    [(i is not None, i or 0) for i in table["page_id"].to_pylist()]))
    run = table["run"].to_pylist()
    starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
    ends = [*starts[1:], len(run)]
    order = [starts[r] + at for r, at in LoserTree([keys[a:b] for a, b in zip(starts, ends)])]
    here = TaskContext.get().partitionId()
    table = table.drop_columns(["run"]).take(pa.array(order, pa.int64()))
    table = table.append_column("part", pa.array([here] * len(order), pa.int32()))
    table = table.append_column("within", pa.array(range(len(order)), pa.int64()))
    yield from table.to_batches(10_000)


def capture_index(captures: DataFrame) -> DataFrame:
    """The captures with url_key and ``position``, their place in the order of url_key, timestamp and page_id over all
    archives, from 0 without gaps. Null timestamps count as empty; ties of all three keep any order."""
    rows = captures.withColumn("captured", F.coalesce("captured", F.lit(""))).withColumn("url_key", url_key(F.col("url")))
    runs = rows.sortWithinPartitions("url_key", "captured", "page_id").withColumn("run", F.spark_partition_id())
    names = ["run", "url_key", *[c for c in rows.columns if c != "url_key"]]
    runs = stored(runs.select(*names), "runs")
    n = runs.count()
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranges = runs.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", "page_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields[1:])
    merged = stored(ranges.mapInArrow(merge, f"{kinds}, part int, within long"), "index")
    counts = merged.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return merged.join(before, "part").withColumn("position", F.col("before") + F.col("within")).drop("part", "within", "before")
