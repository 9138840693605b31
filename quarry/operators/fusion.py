"""Weighted fusion of a text list and a vector list.

Both inputs are ranked lists ``(query_id, rank, doc_id, score)`` fetched at
depth ``depth_factor * k``. They are unioned with a source tag and grouped by
(query, document), which is one shuffle and equals a full outer join:

* fused score: ``w_bm25 * text + w_vector * vector`` (missing side adds 0);
* provenance: ``hybrid`` when in both lists, else ``bm25`` or ``vector``;
* tie order: text-list rows first in text rank order, then vector-only rows
  in vector rank order (a stable sort over an insertion-ordered merge);
* ranked on the unrounded score, then rounded to 4 places.

Documents of one URL are one key: ``aliases`` maps them to the smallest
document id of the URL. A key that appears twice in one list keeps its best
score (one row per key per list) before fusion, and is shown as its first
document in the tie order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import rank_key
from quarry.params import Weights

TEXT_SRC, VECTOR_SRC = 0, 1


def url_aliases(corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, merge_id)`` of documents whose URL has a smaller document id."""
    rows = corpus.select(F.col(key).alias("doc_id"), "url").where(
        F.col("url").isNotNull() & (F.col("url") != ""))
    first = rows.groupBy("url").agg(F.min("doc_id").alias("merge_id"),
                                    F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, "url").where("doc_id <> merge_id").select("doc_id", "merge_id")


def _tagged(ranked: DataFrame, src: int) -> DataFrame:
    return ranked.select("query_id", "doc_id", F.lit(src).alias("src"), "rank", "score")


def fuse(text: DataFrame, vector: DataFrame, weights: Weights,
         aliases: DataFrame | None = None) -> DataFrame:
    """E5 + F1: ``(query_id, doc_id, fused, score_type, src, src_rank)``.

    One aggregation over the union (one shuffle, shared with the ranking
    window): the best score of
    each list per document, weighted and added (text first, as the
    insertion order of the merge has it; a missing side adds nothing).
    """
    # Clustered by query once: the (query, document) aggregation and the
    # ranking window of fused_top_k both keep this partitioning.
    both = _tagged(text, TEXT_SRC).unionByName(_tagged(vector, VECTOR_SRC))
    if aliases is None:
        both = both.withColumn("merge_id", F.col("doc_id"))
    else:
        both = both.join(aliases, "doc_id", "left").withColumn(
            "merge_id", F.coalesce("merge_id", "doc_id"))
    grouped = both.repartition("query_id").groupBy("query_id", "merge_id").agg(
        F.max(F.when(F.col("src") == TEXT_SRC, F.col("score"))).alias("t"),
        F.max(F.when(F.col("src") == VECTOR_SRC, F.col("score"))).alias("v"),
        F.min(F.struct("src", "rank", "doc_id")).alias("first"))
    t = F.col("t") * F.lit(weights.bm25)
    v = F.col("v") * F.lit(weights.vector)
    fused = (F.when(F.col("t").isNull(), v).when(F.col("v").isNull(), t).otherwise(t + v))
    return grouped.select(
        "query_id", F.col("first.doc_id").alias("doc_id"), fused.alias("fused"),
        F.when(F.col("t").isNotNull() & F.col("v").isNotNull(), F.lit("hybrid"))
        .when(F.col("t").isNotNull(), F.lit("bm25"))
        .otherwise(F.lit("vector")).alias("score_type"),
        F.col("first.src").alias("src"), F.col("first.rank").alias("src_rank"))


def fused_top_k(fused: DataFrame, k: int) -> DataFrame:
    """H4 + B15: ``(query_id, rank, doc_id, score, score_type)``."""
    w = Window.partitionBy("query_id").orderBy(
        F.col("_key").desc(), F.col("src").asc(), F.col("src_rank").asc())
    return (fused.withColumn("_key", rank_key("fused"))
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(k))
            .select("query_id", "rank", "doc_id",
                    F.round("fused", 4).alias("score"), "score_type"))
