"""Operator 6: SimHash near-duplicates by pigeonhole blocks.

Fingerprints. A text's A-Z are lowered, its words (runs of other characters
than space and U+0009..U+000D) make 4-word shingles with repeats, and a bit of
the fingerprint is 1 if it is set in more than half of the shingles' XXH64
values. Fewer than four words make one shingle of them all; no word makes
fingerprint zero.

Links. Fingerprints are cut into m blocks. Two of them that differ in at most
4 bits agree on m-4 blocks at least, so joining on every choice of m-4 blocks
misses none; members of a bucket are then compared bit by bit. m (6 to 10)
follows from the number of distinct fingerprints, so that a bucket of
unrelated ones holds few; every m gives the same links. Equal fingerprints are
one class first. A bucket yields a spanning forest of its links, never its
pairs; one of more than ``BUCKET`` members is dealt out in slices, and each
pair of slices is compared in a task of its own, so that every pair still
meets.

Components come from alternating large and small stars over the links, each
round written to the shared folder. Nothing is collected but counts, and no
join broadcasts: Spark sizes a table by its files, before a row is exploded into
up to 210 keys and before repeated roots are unpacked, so that it would send the
driver many times what it allows.

Defined results: null text counts as empty; documents without words have
fingerprint zero and link like any other; repeated ids and rows each get a
row; a null id joins its component, whose id is the smallest that isn't null
(null if there is none); an empty table gives an empty table. Extra columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, python_ready, staged, whole_text

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BUCKET = 1024   # members of a bucket compared in one task


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    words = text.encode("utf-8").lower().split()   # bytes: ASCII letters and blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(line[s:e], SEED) for s, e in zip(
        starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        block = values[at:at + (1 << 14)].view(np.uint8)
        ones += np.unpackbits(block, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): the 64 bits as a signed long."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()],
                             dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_hash", "fp"])

    whole = whole_text(text)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"),
                     F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(blocks: int, differ: int) -> list[int]:
    """Masks of every choice of ``blocks - differ`` blocks, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(single, blocks - differ)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(n: int, differ: int) -> int:
    """Blocks for ``n`` fingerprints: keys of some bits more than log2(n)."""
    for blocks in range(differ + 2, differ + 6):
        if 64 * (blocks - differ) // blocks >= math.log2(max(n, 2)) + 3:
            return blocks
    return differ + 6


def forest(members: np.ndarray, differ: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members`` (distinct values)."""
    left = np.sort(members)
    links = []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        frontier = [root]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count((left ^ np.int64(at)).view(np.uint64)) <= differ
            if near.any():
                found = left[near].tolist()
                links.extend((root, f) for f in found)
                frontier.extend(found)
                left = left[~near]
    return links


def bucket_links(buckets: DataFrame, differ: int) -> DataFrame:
    """(a, b) of each bucket's forest; ``buckets`` has one list ``members``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy()
            links = []
            for s, e in itertools.pairwise(ends.tolist()):
                links.extend(forest(values[s:e], differ))
            table = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(table[:, i])) for i in (0, 1)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that must not be broadcast."""
    return df.hint("merge")


def near_links(classes: DataFrame, differ: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a < b) whose components are those of all pairs within ``differ`` bits."""
    blocks = choose_blocks(classes.count(), differ)
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m))
                                 .alias("part")) for i, m in enumerate(block_masks(blocks, differ))])
    keyed = classes.select("fp", F.explode(choices).alias("key")).select("fp", "key.*")
    shared = (keyed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .withColumn("slices", F.ceil(F.col("n") / F.lit(bucket)).cast("int")).drop("n"))
    met = keyed.join(shuffled(shared), ["choice", "part"])
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    met = met.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    lists = met.groupBy("choice", "part", F.least("own", "other").alias("s"),
                        F.greatest("own", "other").alias("t")).agg(
        F.collect_list("fp").alias("members"))
    return bucket_links(lists.select("members").where(F.size("members") > 1), differ).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(shuffled(least), "u").where("v > u").select(
        F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(shuffled(least), "b")
    pulled = joined.where("a <> m").select("m", "a").union(least.select("m", "b"))
    return pulled.toDF("a", "b").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of every node with a link; root is the component's least.

    ``edges`` (a < b) shrink to stars; a round changes nothing once they are.
    """
    edges = staged(edges, name)
    seen = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen or not sums[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = tuple(sums)
        edges = staged(small_star(large_star(edges)), name)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE_WORDS, differ: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row.

    ``root`` is a fingerprint that names the component.
    """
    prints = staged(fingerprints(df, doc_id, text, shingle), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    stars = components(near_links(classes.select("fp"), differ))
    rooted = classes.join(shuffled(stars.withColumnRenamed("node", "fp")), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(shuffled(ids), "root").select("fp", "root", "component_id"), "named")
    return prints.join(shuffled(named), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keepers(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of one row per component of ``near_duplicates``: that
    of the smallest id, a null one only where there is no other."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    return found.groupBy("root").agg(first.alias("first")).select(
        "first.doc_id", "first.text_hash")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
