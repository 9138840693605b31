"""Operator 9: WARC archives and a globally ordered capture index.

Writing. Every page becomes one record: a ``response`` with its payload, or a
``revisit`` that names the response of an equal payload (the smallest page id
of the group). Groups are found by digest: (digest, smallest id, count) is
aggregated with map-side combine, and the groups of two or more are written
down. Joining them back moves no payload where that table is small enough for
Spark to broadcast; else it is a sort-merge join, whose hot digests adaptive
execution splits. Spark's text writer commits the files; its line separator is
the two line ends that close a WARC record, so the files are plain
uncompressed WARC.

Index. Each archive file yields a locally sorted capture run of (URL key,
timestamp, page id, file, offset, size). Runs are dealt out by range of URL
key, and every task merges the pieces of its k runs with a loser tree, so the
output files hold globally ordered capture histories; no task sees more than
its range.

Defined results: null or empty html is an empty payload (equal empty payloads
revisit too); a null page id or URL sorts first in the index and comes back as null (a
page without id is a group's response only where no page has one);
repeated page ids each get a record, the group's response being the first of
the smallest id by URL; an empty table gives no records. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import python_ready, staged, table, dealt
from quarry.session import scratch_path

SHARD_BYTES = 16 << 20   # about so many bytes per archive file
RUN_RANGE_ROWS = 100_000  # captures per range of the merged index
MIN_REVISIT_BYTES = 0    # smaller payloads are always responses
EPOCH = datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc)
LAST_SECOND = 250 * 10**9   # of page ids told apart, some 7,900 years

# Fixed values of the format.
VERSION = "WARC/1.1"
LINE_END = "\r\n"
LINE_ENDS = re.compile("[\r\n]")
CLOSE = LINE_END * 2
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = ("run string, url_key string, timestamp string, page_id long, record_type string, "
            "refers_to long, payload_digest string, payload_bytes long, url string, "
            "file string, offset long, size long")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def url_key(url: str | None) -> str | None:
    """Sort-friendly form: host labels reversed, then port and path."""
    if url is None:
        return None
    rest = url.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host, _, port = host.lower().partition(":")
    return ",".join(reversed(host.split("."))) + (":" + port if port else "") + ")" + slash + path


def timestamp(page_id: int | None) -> str:
    """Capture time of a table without one: one second per page id, up to the
    last year that a date can hold."""
    at = EPOCH + datetime.timedelta(seconds=(page_id or 0) % LAST_SECOND)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def header_line(value: str) -> str:
    """A header value with line ends: these and percent signs are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unescaped(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC record without its closing line ends."""
    body = b"" if revisit else payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Date: {timestamp(page_id)}",
             f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             f"X-Payload-Length: {len(payload)}"]
    if url is not None and LINE_ENDS.search(url):
        lines += [f"WARC-Target-URI: {header_line(url)}", "X-Target-URI-Escaped: 1"]
    elif url is not None:
        lines.append(f"WARC-Target-URI: {url}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}",
                  f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return (LINE_END.join(lines) + CLOSE).encode("utf-8") + body


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, size, headers, block) of every record; raises on damage."""
    at, close = 0, CLOSE.encode()
    while at < len(content):
        head = content.find(close, at)
        lines = content[at:head].decode("utf-8").split(LINE_END) if head >= 0 else [""]
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head + len(close)
        end = start + int(headers["Content-Length"])
        if content[end:end + len(close)] != close:
            raise ValueError(f"record at byte {at} isn't closed")
        yield at, end + len(close) - at, headers, content[start:end]
        at = end + len(close)


def page_of(urn: str | None) -> int | None:
    inner = (urn or "")[len("<urn:page:"):-1]
    return int(inner) if inner else None


class LoserTree:
    """Merges k sorted iterators; each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for run in range(self.k):
            self.play(run)

    def beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0   # a seat not taken yet wins, so every run gets seated
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None and y is None or (x is None) == (y is None) and a < b
        return x < y or x == y and a < b

    def play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            run = self.losers[0]
            yield head
            self.heads[run] = next(self.runs[run], None)
            self.play(run)


def payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b"").cast("binary"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES,
                   shard_bytes: int = SHARD_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``/warc."""
    spark = pages.sparkSession
    python_ready(spark)
    rows = dealt(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                              payload(F.col("html")).alias("payload")))
    digested = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    sizes = F.octet_length("payload")
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id",
                           F.coalesce("url", F.lit("")).alias("url")))
    groups = (digested.where(sizes >= min_bytes).groupBy("digest")
              .agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("digest", "first"))
    groups = staged(groups, "payload-groups")
    mean = rows.agg(F.avg(sizes)).first()[0] or 0
    records = max(1, int(shard_bytes / (mean + 500)))
    marked = digested.join(groups, "digest", "left").select(
        "page_id", "url", "payload", F.col("first.page_id").alias("refers_to"),
        F.col("first").isNotNull().alias("grouped"),
        F.col("first").eqNullSafe(F.struct(
            F.col("page_id").isNull().alias("unknown"), "page_id",
            F.coalesce("url", F.lit("")).alias("url"))).alias("is_first"))
    marked = marked.withColumn("revisit", F.col("grouped") & ~F.col("is_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = [record(i, u, p.as_buffer().to_pybytes(), r, v) for i, u, p, r, v in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(written, pa.binary())], ["record"])

    (marked.select("page_id", "url", "payload", "refers_to", "revisit")
     .mapInArrow(run, "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", records).option("lineSep", CLOSE).option("compression", "none").text(f"{path}/warc"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives back: one locally sorted run of captures per file.

    Digests and lengths of responses are taken from the block itself.
    """
    python_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CAPTURES.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]
                 for f in CAPTURES.split(", ")]
        for batch in batches:
            for number, file, content in zip(*batch.columns, strict=True):
                rows = []
                for at, size, h, block in parse(content.as_buffer().to_pybytes()):
                    revisit = h["WARC-Type"] == "revisit"
                    digest, length = h["WARC-Payload-Digest"][5:], int(h["X-Payload-Length"])
                    if not revisit and (base32_sha1(block), len(block)) != (digest, length):
                        raise ValueError(f"damaged payload at byte {at} of {file}")
                    url = h.get("WARC-Target-URI")
                    url = unescaped(url) if "X-Target-URI-Escaped" in h else url
                    rows.append((number.as_py(), url_key(url), h["WARC-Date"],
                                 page_of(h["WARC-Record-ID"]), h["WARC-Type"],
                                 page_of(h.get("WARC-Refers-To")), digest, length, url,
                                 file.as_py(), at, size))
                rows.sort(key=capture_key)
                for i in range(0, len(rows), 1000):
                    columns = zip(*rows[i:i + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
             .load(f"{path}/warc")
             .select(F.regexp_replace("path", r"^.*/part-(\d+)-[^/]*-(c\d+)[^/]*$", "$1-$2")
                     .alias("run"), F.col("path").alias("file"), "content"))
    return files.mapInArrow(run, CAPTURES)


def capture_key(row: tuple) -> tuple:
    """(URL key, timestamp, page id), nulls first."""
    _, key, at, page = row[:4]
    return key is not None, key or "", at, page is not None, page or 0


def merge_runs(runs: DataFrame, range_rows: int = RUN_RANGE_ROWS) -> DataFrame:
    """All captures in order of (URL key, timestamp, page id).

    Partitions hold consecutive key ranges, so that the files read one after
    another are the capture histories of all URL keys. The range bounds include
    timestamp and page id, so one URL's captures may span partitions.
    """
    spark = runs.sparkSession
    python_ready(spark)
    ranges = max(1, math.ceil(runs.count() / range_rows))
    order = [F.col("url_key").asc_nulls_first(), "timestamp", F.col("page_id").asc_nulls_first()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[int, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_run.setdefault(row[0], []).append((capture_key(row), row))
        merged = iter(LoserTree([iter(by_run[r]) for r in sorted(by_run)]))
        while block := [row for _, (_, row) in zip(range(1000), merged)]:
            columns = zip(*block, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # Each run's piece of a range arrives in the run's own order.
    return (runs.repartitionByRange(ranges, *order)
            .sortWithinPartitions("run", *order).mapInArrow(run, runs.schema))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back, and listed in capture order."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    runs = staged(read_captures(spark, path), "captures")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                   "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha1(encode(html)) AS hex
  FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT
      >> (15 - 5 * (i % 4)))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
