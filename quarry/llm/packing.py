"""Operator 8: best-fit packing under source and duplicate conflicts.

Documents are packed into sequences (bins) of ``capacity`` units, with no two
documents of one source and no two of one duplicate cluster in a bin. Longer
documents are cut: full pieces fill a bin each, the rest is packed.

A duplicate cluster is a component of near duplicates (operator 6). Items, the
pieces, are counted and dealt out evenly to shards by a hash of id and piece, so
a hot source or cluster spreads over all of them, and a shard holds about
``SHARD_ITEMS`` pieces whatever the texts' lengths. A shard packs its items from the longest down. Open bins are
ordered by residual and carry a bitmap of the sources and clusters in them.
The search starts at the smallest residual that holds the item and goes on to
its successors until a bin without the item's bits turns up, which is the
tightest compatible one; if there is none, a bin is opened. For sources and
clusters with many items in the shard, the residuals that have a bin without
them are kept as a bit set, so that the search steps over full runs at once.

Defined results: null or empty text has length 0 and takes a place in a bin; a
null source never conflicts, nor does a null cluster; rows of equal id are
separate items (equal texts share a cluster, hence never a bin); an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import collapse_space, documents, python_ready, staged, whole_text
from quarry.llm.simhash import near_duplicates

CAPACITY = 16_384      # characters of a sequence
SHARD_ITEMS = 20_000   # items packed together
FREQUENT = 32          # items of a source or cluster that make it indexed

ITEM = ("item long, doc_id long, piece int, start long, length long, source string, "
        "cluster long, whole boolean")
SCHEMA = ("doc_id long, piece int, start long, length long, source string, cluster long, "
          "bin_id long, bin_offset long, bin_used long")


class Packer:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int, frequent: set[int]):
        self.capacity = capacity
        self.levels: list[dict[int, list[int]] | None] = [None] * (capacity + 1)
        self.any = 0   # bit r: there is a bin of residual r
        self.frequent = frequent
        self.without = {b: 0 for b in frequent}   # bit r: one of them lacks bit b
        self.lacking: dict[int, Counter] = {b: Counter() for b in frequent}
        self.used: list[int] = []

    def find(self, size: int, bits: int, indexed: list[int]) -> tuple[int, int] | None:
        """(residual, bitmap) of the tightest bin compatible with the item."""
        fits = self.any
        for b in indexed:
            fits &= self.without[b]
        fits >>= size
        at = size
        while fits:
            step = (fits & -fits).bit_length() - 1
            at, fits = at + step, fits >> step
            for bitmap in self.levels[at]:
                if not bitmap & bits:
                    return at, bitmap
            at, fits = at + 1, fits >> 1
        return None

    def put(self, number: int, residual: int, bitmap: int) -> None:
        level = self.levels[residual]
        if level is None:
            level = self.levels[residual] = {}
        if not level:
            self.any |= 1 << residual
        level.setdefault(bitmap, []).append(number)
        for b in self.frequent:
            if not bitmap >> b & 1:
                n = self.lacking[b]
                n[residual] += 1
                if n[residual] == 1:
                    self.without[b] |= 1 << residual

    def take(self, residual: int, bitmap: int) -> int:
        level = self.levels[residual]
        numbers = level[bitmap]
        number = numbers.pop()
        if not numbers:
            del level[bitmap]
            if not level:
                self.any ^= 1 << residual
        for b in self.frequent:
            if not bitmap >> b & 1:
                n = self.lacking[b]
                n[residual] -= 1
                if not n[residual]:
                    self.without[b] ^= 1 << residual
        return number

    def add(self, size: int, bits: int, indexed: list[int]) -> tuple[int, int]:
        """Place an item; its (bin, offset)."""
        found = self.find(size, bits, indexed)
        if found is None:
            number, residual, bitmap = len(self.used), self.capacity, 0
            self.used.append(0)
        else:
            residual, bitmap = found
            number = self.take(residual, bitmap)
        offset = self.capacity - residual
        self.put(number, residual - size, bitmap | bits)
        self.used[number] = offset + size
        return number, offset


def pack_items(lengths: list[int], sources: list[str | None], clusters: list[int],
               capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each item, given from the longest down; and bins' use."""
    counts = Counter(("s", s) for s in sources if s is not None)
    counts.update(("c", c) for c in clusters if c is not None)
    bit = {k: i for i, k in enumerate(sorted(
        (k for k, n in counts.items() if n > 1), key=lambda k: (-counts[k], k)))}
    frequent = {i for k, i in bit.items() if counts[k] >= FREQUENT}
    packer = Packer(capacity, frequent)
    placed = []
    for size, s, c in zip(lengths, sources, clusters, strict=True):
        own = [bit[k] for k in (("s", s), ("c", c)) if k in bit]
        placed.append(packer.add(size, sum(1 << b for b in own),
                                 [b for b in own if b in frequent]))
    return placed, packer.used


def pieces(df: DataFrame, doc_id: str, length: str, source: str, cluster: str,
           capacity: int) -> DataFrame:
    """One row per piece; ``whole`` pieces fill a bin."""
    n = F.greatest(F.lit(1), F.ceil(F.col(length) / F.lit(capacity))).cast("int")
    rows = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long")
        .alias("total"), F.col(source).cast("string").alias("source"),
        F.col(cluster).cast("long").alias("cluster"),
        F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    rows = rows.withColumns({"start": start,
                             "length": F.least(F.lit(capacity), F.col("total") - start)})
    return rows.select(
        F.xxhash64("doc_id", "piece", "cluster").alias("item"), "doc_id", "piece", "start",
        "length", "source", "cluster", (F.col("length") == capacity).alias("whole"))


def pack(df: DataFrame, doc_id: str = "doc_id", length: str = "length", source: str = "source",
         cluster: str = "cluster", capacity: int = CAPACITY,
         shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The bin and place of every piece of every document."""
    python_ready(df.sparkSession)
    items = pieces(df, doc_id, length, source, cluster, capacity)
    each = F.greatest(F.lit(1), F.ceil(F.coalesce(length, F.lit(0)) / F.lit(capacity)))
    shards = max(1, math.ceil((df.agg(F.sum(each)).first()[0] or 0) / shard_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]   # a shard: a bounded number of narrow rows
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard = t["shard"][0].as_py()
        rows = t.select(["doc_id", "piece", "start", "length", "source", "cluster", "whole"])
        rows = list(zip(*(c.to_pylist() for c in rows.columns), strict=True))
        full, rest = [r for r in rows if r[-1]], [r for r in rows if not r[-1]]
        placed, used = pack_items([r[3] for r in rest], [r[4] for r in rest],
                                  [r[5] for r in rest], capacity)
        out = [(*r[:-1], len(used) + i, 0, capacity) for i, r in enumerate(full)]
        out += [(*r[:-1], b, o, used[b]) for r, (b, o) in zip(rest, placed, strict=True)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 4
        columns = [list(c) for c in zip(*out, strict=True)]
        columns[6] = [(shard << 32) + b for b in columns[6]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [f.split()[0] for f in SCHEMA.split(", ")])

    dealt = items.withColumn("shard", F.pmod("item", F.lit(shards)).cast("int"))
    return (dealt.repartitionById(shards, F.col("shard"))
            .sortWithinPartitions(F.col("length").desc(), "item", "start")
            .mapInArrow(run, SCHEMA))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, length, source, cluster): characters, and a hash of the text
    without its case and spacing, for documents without near duplicates."""
    text = whole_text()
    return docs.select("doc_id", F.char_length(text).cast("long").alias("length"), "source",
                       F.xxhash64(collapse_space(text)).alias("cluster"))


def clustered(docs: DataFrame) -> DataFrame:
    """(doc_id, length, source, cluster): the cluster is the fingerprint that
    names the document's component of near duplicates."""
    found = near_duplicates(docs.select("doc_id", "text")).groupBy("doc_id", "text_hash").agg(
        F.min("root").alias("cluster")).toDF("_id", "_hash", "cluster")
    text = whole_text()
    rows = docs.select("doc_id", F.char_length(text).cast("long").alias("length"), "source",
                       F.xxhash64(text).alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    # Written down: counted and packed from the same rows.
    return staged(rows.join(found, same).select("doc_id", "length", "source", "cluster"), "clustered")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences."""
    return pack(clustered(documents(spark, sf_dir)))
