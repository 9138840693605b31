"""Text top-k with score bounds: block-max and MaxScore over a query table
(D5, E1, H1).

Layout (:func:`build_blocks`). Documents of about one length are dealt into
blocks of some ``BLOCK_DOCS``; a row of ``blocks`` is one term's postings in
one block: ``(term, dblock, max_part, entries[(doc_id, part)])``, partitioned
by term bucket and bucketed by ``dblock``, so that a document's postings are in
one task. ``tops(term, max_part)`` holds each term's largest part. Lengths are
kept apart because a posting's part falls with its document's length: bounds of
mixed blocks are looser.

Search (:func:`pruned_hits`) gives every (query, document) that can be among
the query's best k, with its whole score:

1. *Bounds.* ``max_part`` times the term's weight, summed over a query's terms,
   bounds the scores in a block. This pass doesn't read ``entries``.
2. *Threshold.* The few blocks with the largest bounds are scored; the k-th
   score found is below no query's true k-th score. A query with fewer hits
   gets threshold 0, which prunes nothing.
3. *Essential terms.* Of a query's terms, from the least ``max_part`` on, those
   whose bounds add up to less than the threshold can't bring a document into
   the list alone. The others are essential: only their postings, in blocks
   whose bound reaches the threshold, propose documents.
4. *Completion.* A proposed document whose score so far, plus the bound of the
   other terms in its block, reaches the threshold is completed from their
   postings in that block.

Weights must not be negative (``text_top_k_pruned`` falls back otherwise).
Joins with per-query tables are broadcast where their counted rows are within
bounds, else shuffled by block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.bm25 import first_docs_pad, normalize_by_top, rank_top_k, text_top_k
from quarry.operators.index import Bm25Index, term_bucket, write_bucketed
from quarry.session import bounded_broadcast, scratch_path, write_parquet

BLOCK_DOCS = 64
SEEDS = 4            # blocks scored for the threshold
SLACK = 4e-9         # above the grid of the rank key and the order of sums


@dataclass
class Blocks:
    table: DataFrame   # term, tbucket, dblock, max_part, entries
    tops: DataFrame    # term, max_part


def length_class(dl: Column) -> Column:
    return F.floor(2 * F.log2(dl + 1)).cast("int")


def build_blocks(index: Bm25Index, path: str | None = None,
                 block_docs: int = BLOCK_DOCS) -> Blocks:
    """Write the blocks of an index: one shuffle of its postings."""
    spark = index.docs.sparkSession
    path = path or scratch_path(spark, "blocks")
    classes = index.docs.groupBy(length_class(F.col("dl")).alias("c")).count().collect()   # < 100
    splits = F.create_map(*[F.lit(x) for r in classes
                            for x in (r["c"], math.ceil(r["count"] / block_docs))]) \
        if classes else F.create_map(F.lit(0), F.lit(1))
    own = length_class(F.col("dl"))
    dblock = (F.shiftleft(own.cast("long"), 40)
              + F.pmod(F.xxhash64("doc_id"), F.element_at(splits, own).cast("long")))
    rows = index.postings.select("term", "tbucket", dblock.alias("dblock"), "doc_id", "part")
    grouped = rows.repartition(index.stats.n_doc_buckets, "dblock").groupBy(
        "tbucket", "term", "dblock").agg(
        F.max("part").alias("max_part"),
        F.collect_list(F.struct("doc_id", "part")).alias("entries"))
    table = write_bucketed(grouped, f"{path}/blocks", index.stats.n_doc_buckets, "dblock")
    tops = write_parquet(table.groupBy("term").agg(F.max("max_part").alias("max_part")),
                         f"{path}/tops")
    return Blocks(table, tops)


def weighted_terms(index: Bm25Index, blocks: Blocks, qterms: DataFrame) -> DataFrame:
    """``(query_id, term, tbucket, w, top)``; ``top`` bounds the term's contribution."""
    own = qterms.where(F.col("query_id").isNotNull() & (F.length("term") > 0)).withColumn(
        "tbucket", term_bucket("term", index.stats.n_buckets))
    weights = own.join(index.terms.select("tbucket", "term", "idf"), ["tbucket", "term"]).join(
        blocks.tops, "term")
    w = F.col("qtf").cast("double") * F.col("idf")
    return weights.select("query_id", "term", w.alias("w"), (w * F.col("max_part")).alias("top"),
                          "tbucket")


def bounds(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, dblock, bound)`` from ``max_part`` alone."""
    met = blocks.select("tbucket", "term", "dblock", "max_part").join(terms, ["tbucket", "term"])
    return met.groupBy("query_id", "dblock").agg(
        F.sum(F.col("w") * F.col("max_part")).alias("bound"))


def scores(blocks: DataFrame, terms: DataFrame, where: DataFrame) -> DataFrame:
    """``(query_id, dblock, doc_id, raw, read)`` over the blocks of ``where
    (query_id, dblock)``; ``read`` counts the postings summed."""
    met = blocks.join(terms, ["tbucket", "term"]).join(where, ["query_id", "dblock"])
    each = met.select("query_id", "dblock", "w", F.explode("entries").alias("e"))
    return each.groupBy("query_id", "dblock", "e.doc_id").agg(
        F.sum(F.col("w") * F.col("e.part")).alias("raw"), F.count(F.lit(1)).alias("read"))


def reaches(score: Column, threshold: Column) -> Column:
    return score >= threshold - F.lit(SLACK) * (1 + threshold)


def pruned_hits(index: Bm25Index, blocks: Blocks, qterms: DataFrame, k: int,
                seeds: int = SEEDS) -> DataFrame:
    """``(query_id, doc_id, raw, read)``: whole scores of all documents that may
    be among the best ``k`` of their query."""
    spark = index.docs.sparkSession
    path = scratch_path(spark, "pruned")
    terms = write_parquet(weighted_terms(index, blocks, qterms), f"{path}/terms")
    small, _, _ = bounded_broadcast(terms)
    limits = write_parquet(bounds(blocks.table, small), f"{path}/bounds")

    best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "dblock")
    first = limits.withColumn("_n", F.row_number().over(best)).where(
        F.col("_n") <= seeds).select("query_id", "dblock")
    sample = rank_top_k(scores(blocks.table, small, bounded_broadcast(first)[0]), k)
    found = sample.groupBy("query_id").agg(F.min("raw").alias("least"),
                                           F.count(F.lit(1)).alias("n"))
    # Terms from the least bound on, as long as their sum stays under the threshold.
    upward = Window.partitionBy("query_id").orderBy("top", "term")
    split = terms.join(found, "query_id", "left").withColumn(
        "threshold", F.when(F.col("n") == k, F.col("least")).otherwise(0.0)).withColumn(
        "essential", reaches(F.sum("top").over(upward), F.col("threshold")))
    split = write_parquet(split.drop("least", "n"), f"{path}/split")
    thresholds = split.select("query_id", "threshold").distinct()

    alive = limits.join(bounded_broadcast(thresholds)[0], "query_id").where(
        reaches(F.col("bound"), F.col("threshold"))).select("query_id", "dblock")
    leading = bounded_broadcast(split.where("essential").drop("top", "threshold", "essential"))[0]
    others = bounded_broadcast(split.where("NOT essential").drop("top", "threshold",
                                                                 "essential"))[0]
    proposed = scores(blocks.table, leading, bounded_broadcast(alive)[0])
    rest = bounds(blocks.table, others).withColumnRenamed("bound", "rest")
    open_ = proposed.join(rest, ["query_id", "dblock"], "left").join(
        bounded_broadcast(thresholds)[0], "query_id").where(reaches(
            F.col("raw") + F.coalesce("rest", F.lit(0.0)), F.col("threshold")))
    candidates = write_parquet(open_.select("query_id", "dblock", "doc_id", "raw", "read"),
                               f"{path}/candidates")
    places = bounded_broadcast(candidates.select("query_id", "dblock").distinct())[0]
    more = scores(blocks.table, others, places).select(
        "query_id", "dblock", "doc_id", F.col("raw").alias("_raw"), F.col("read").alias("_read"))
    whole = candidates.join(more, ["query_id", "dblock", "doc_id"], "left")
    zero = F.lit(0)
    return whole.select("query_id", "doc_id",
                        (F.col("raw") + F.coalesce("_raw", zero)).alias("raw"),
                        (F.col("read") + F.coalesce("_read", zero)).alias("read"))


def text_top_k_pruned(index: Bm25Index, blocks: Blocks, queries: DataFrame, qterms: DataFrame,
                      k: int, pad: bool = True) -> DataFrame:
    """The rows of ``text_top_k``, from fewer postings."""
    if index.stats.epsilon * index.stats.avg_idf < 0:
        return text_top_k(index, queries, qterms, k, pad=pad)
    top = rank_top_k(pruned_hits(index, blocks, qterms, k).drop("read"), k).select(
        "query_id", "doc_id", "raw")
    if pad:
        padded = top.unionByName(first_docs_pad(index, queries.select("query_id"), k))
        top = padded.groupBy("query_id", "doc_id").agg(F.max("raw").alias("raw"))
    return normalize_by_top(rank_top_k(top, k)).select("query_id", "rank", "doc_id", "raw", "score")

