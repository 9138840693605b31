"""Operator 4: token ids as length-delimited binary records with an index.

File format. Records follow each other in ascending document order; each is

    8 bytes   payload length, unsigned little-endian
    4 bytes   masked checksum of those 8 bytes
    payload   1 flag byte, 8-byte document id, the ids (2 or 4 bytes each)
    4 bytes   masked checksum of the payload
    1 byte    line feed

A masked checksum is CRC-32 rotated right by 15 bits plus a constant, so that
checksums of data that itself holds checksums stay sound. The files are
written by Spark's text writer (raw bytes, line feed after each record), so
task commits, retries and remote stores are Spark's. The offset index is a
separate table made by walking the files' frames once: (shard, file, place,
offset, size, doc_id, n_tokens, ids_crc32, start), from which ``read_at`` fetches
any records in any order. ``ids_crc32`` is that of the ids, four bytes each.

The corpus moves once: whole texts are range-partitioned by document id, and
every task sorts, encodes, frames and writes its range.

Encoding: ids are those of the tokenizers library for each chunk between white
space (the vocabulary's rules never look across white space); workers keep a
bounded memo of chunks, and new ones are encoded many at a time (``wordranks``).

Defined results: null or empty text is a record of the end id alone; a null
document id sorts first and comes back as null; repeated ids keep all their
records; an empty table writes no records and an empty index. Shards are sized
by text bytes, so a long text only makes its own record longer.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import share
from quarry.llm.common import documents, python_ready, whole_text
from quarry.llm.wordbpe import MEMO_CHARS, Splitter
from quarry.llm.wordranks import WordRanks
from quarry.session import scratch_path

SHARD_BYTES = 16 << 20   # text bytes per file
BLOCK_CHARS = 1 << 21    # characters whose new chunks are encoded together
MEMO_CHUNKS = 250_000    # entries per generation of the chunk memo
END_ID = 1

# Fixed values of the frame.
MASK_DELTA = 0xA282EAD8
NULL_ID, WIDE_IDS = 1, 2
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<Bq")
CHECK = struct.Struct("<I")

INDEX_SCHEMA = ("shard int, file string, place long, offset long, size long, doc_id long, "
                "n_tokens long, ids_crc32 long, local_start long")

_CODERS: dict[int, tuple] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One framed record, without the closing line feed."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = BODY.pack((doc_id is None) * NULL_ID | wide * WIDE_IDS, doc_id or 0)
    payload += ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + CHECK.pack(masked(length)) + payload + CHECK.pack(masked(payload))


def records(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, size, document id, ids) of each record; raises on damage."""
    at, view = 0, memoryview(content)
    while at < len(content):
        n, check = HEAD.unpack_from(content, at)
        if masked(content[at:at + 8]) != check:
            raise ValueError(f"damaged length at byte {at}")
        end = at + HEAD.size + n
        payload = view[at + HEAD.size:end]
        if len(payload) != n or masked(payload) != CHECK.unpack_from(content, end)[0]:
            raise ValueError(f"damaged record at byte {at}")
        flags, doc_id = BODY.unpack_from(payload)
        ids = np.frombuffer(payload[BODY.size:], "<u4" if flags & WIDE_IDS else "<u2")
        yield at, end + CHECK.size + 1 - at, None if flags & NULL_ID else doc_id, ids
        at = end + CHECK.size + 1


class LibraryCoder:
    """The tokenizers library's ids, behind a bounded memo of chunks.

    New chunks of a block of texts are encoded together (``wordranks``); what
    that can't prove goes to the library.
    """

    def __init__(self, data: bytes):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.splitter = Splitter(json.loads(data))
        self.young: dict[str, bytes] = {}   # two generations of known chunks
        self.old: dict[str, bytes] = {}
        self.ranks = WordRanks(data, self.chunk)

    def chunk(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, block by block."""
        start, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= BLOCK_CHARS or i == len(texts) - 1:
                yield from self.block(texts[start:i + 1])
                start, held = i + 1, 0

    def block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Runs of chunks are laid end to end, told apart once as a dictionary
        array, and the ids of the distinct ones are dealt out by their indexes."""
        split = [list(self.splitter.pieces(t)) for t in texts]
        runs = [chunks for pieces in split for _, chunks in pieces if chunks]
        at = np.cumsum([0] + [len(r) for r in runs])
        if runs:
            line = "\n".join(["\n".join(r) for r in runs])
            found = pc.split_pattern(pa.array([line]), "\n").values.dictionary_encode()
            where = found.indices.to_numpy()
            coded = self.known(found.dictionary.to_pylist())
            size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            start = np.cumsum(size) - size
            each = size[where]
            end = np.cumsum(each)
            place = np.repeat(start[where] - (end - each), each) + np.arange(end[-1])
            ids = np.frombuffer(b"".join(coded), "<u4")[place]
            at = np.append(0, end)[at]
        run = 0
        for pieces in split:
            parts = []
            for special, chunks in pieces:
                if chunks is None:
                    parts.append(np.array([special], "<u4"))
                elif chunks:
                    parts.append(ids[at[run]:at[run + 1]])
                    run += 1
            yield np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def known(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct chunks, from the memo or all new ones at once."""
        coded = list(map(self.young.get, distinct))
        missing = [i for i, x in enumerate(coded) if x is None]
        before = {i: x for i in missing if (x := self.old.get(distinct[i])) is not None}
        new = [i for i in missing if i not in before]
        before.update(zip(new, self.ranks.encode([distinct[i] for i in new]), strict=True))
        for i, x in before.items():
            coded[i] = x
        if len(self.young) + len(before) > MEMO_CHUNKS:
            self.old, self.young = self.young, dict(zip(distinct, coded, strict=True))
            added = distinct
        else:
            added = [distinct[i] for i in missing]
            self.young.update(zip(added, map(before.__getitem__, missing), strict=True))
        for c in [c for c in added if len(c) > MEMO_CHARS]:
            del self.young[c]
        return coded


def coder(data: bytes) -> LibraryCoder:
    key = zlib.crc32(data)
    if key not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODERS.clear()
        _CODERS[key] = LibraryCoder(data)
    return _CODERS[key]


def write_records(df: DataFrame, path: str, vocab_path: str, doc_id: str = "doc_id",
                  text: str = "text", end_id: int = END_ID,
                  shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``text`` and write the record files under ``path``/records."""
    spark = df.sparkSession
    python_ready(spark)
    vocab = share(spark, vocab_path)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocab.value)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            encoded = own.encode(batch.column(1).to_pylist())
            framed = [frame(i, np.concatenate([ids, end])) for i, ids in zip(
                batch.column(0).to_pylist(), encoded, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["record"])

    (rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
     .mapInArrow(run, "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("compression", "none").text(f"{path}/records"))


def record_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, file, content): one row per record file."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
             .load(f"{path}/records"))
    return files.select(
        F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int").alias("shard"),
        F.col("path").alias("file"), "content")


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Walk the record files once and write the offset index beside them."""
    python_ready(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("file", pa.string())] + [
            (n, pa.int64()) for n in ("place", "offset", "size", "doc_id", "n_tokens",
                                      "ids_crc32", "local_start")])
        for batch in batches:
            for shard, file, content in zip(*(c for c in batch.columns), strict=True):
                data, rows, start = content.as_buffer().to_pybytes(), [], 0
                for place, (at, size, doc, ids) in enumerate(records(data)):
                    rows.append((place, at, size, doc, len(ids),
                                 zlib.crc32(ids.astype("<u4").tobytes()), start))
                    start += len(ids)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * len(rows), pa.int32()),
                     pa.array([file.as_py()] * len(rows), pa.string())]
                    + [pa.array(c, pa.int64()) for c in columns], schema=schema)

    index = record_files(spark, path).mapInArrow(walk, INDEX_SCHEMA)
    # One row per file: ids in all files before it.
    index.write.parquet(f"{path}/walked")
    walked = spark.read.parquet(f"{path}/walked")
    sums = walked.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    from pyspark.sql import Window as W
    before = F.sum("shard_tokens").over(
        W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    (walked.join(F.broadcast(bases), "shard")
     .withColumn("start", F.col("base") + F.col("local_start"))
     .drop("base", "local_start").write.parquet(f"{path}/index"))
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records: shard, place, doc_id, n_tokens, ids (binary, four bytes each)."""
    python_ready(spark)
    schema = "shard int, place long, doc_id long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = enumerate(records(content.as_buffer().to_pybytes()))
                yield from blocks(shard.as_py(), ((p, d, i) for p, (_, _, d, i) in rows))

    return record_files(spark, path).select("shard", "content").mapInArrow(run, schema)


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` (rows of the index), in no given order.

    A shuffled reader passes the rows of its next block of an epoch. Files
    that hold none of them are dropped; the others meet their offsets in a
    join on the file name.
    """
    python_ready(spark)
    schema = "shard int, place long, doc_id long, n_tokens long, ids binary"
    places = wanted.groupBy("file").agg(F.collect_list(
        F.struct("place", "offset", "size")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content, at in zip(*batch.columns, strict=True):
                data = content.as_buffer().to_pybytes()
                yield from blocks(shard.as_py(), (
                    (x["place"], *next(records(data[x["offset"]:x["offset"] + x["size"]]))[2:])
                    for x in at.as_py()))

    files = record_files(spark, path).join(places, "file")
    return files.select("shard", "content", "at").mapInArrow(run, schema)


def blocks(shard: int, rows, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Record rows as Arrow batches of at most ``size`` rows."""
    place, doc, n, ids = [], [], [], []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(n), pa.int32()), pa.array(place, pa.int64()),
             pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
            ["shard", "place", "doc_id", "n_tokens", "ids"])

    for p, d, i in rows:
        place.append(p)
        doc.append(d)
        n.append(len(i))
        ids.append(i.astype("<u4").tobytes())
        if len(n) == size:
            yield batch()
            place, doc, n, ids = [], [], [], []
    if n:
        yield batch()


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a record; all comes from the walk that reads
    the files back for the index."""
    import public_tokenizers

    path = scratch_path(spark, "token-records")
    write_records(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return write_index(spark, path).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "size")
