"""Rank fusion, graded relevance metrics and second-stage scoring.

* :func:`reciprocal_rank_fusion`: lists fused by rank positions alone,
  ``sum(1 / (60 + rank))`` (Cormack, Clarke and Buettcher 2009).
* :func:`term_judgements`: gains of (query, document) pairs from the postings:
  ``FULL_GAIN`` for a document with all of the query's distinct terms,
  ``PART_GAIN`` for one with ``PART_SHARE`` of them at least.
* :func:`relevance_at_k`: precision, recall and NDCG of ranked lists against
  such judgements. Unjudged rows have gain 0. Queries without a relevant
  document have no recall or NDCG and are left out of those means.
* :func:`rerank`: the rows of a ranked list with their documents' texts,
  scored again by a caller's scorer in Arrow batches, and ranked by that.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.bm25 import rank_top_k
from quarry.operators.index import Bm25Index, term_bucket
from quarry.session import bounded_broadcast, ship_package

# --- fixed values -------------------------------------------------------------
RRF_K = 60
# --- end of fixed values ------------------------------------------------------
FULL_GAIN, PART_GAIN, PART_SHARE = 3, 1, 0.6


def reciprocal_rank_fusion(lists: Sequence[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` from lists ``(query_id, rank, doc_id)``;
    of equal scores the smaller document id goes first."""
    both = None
    for found in lists:
        rows = found.select("query_id", "doc_id", (1.0 / (F.lit(constant) + F.col("rank"))).alias("s"))
        both = rows if both is None else both.unionByName(rows)
    fused = both.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))
    return rank_top_k(fused, k, "score").select("query_id", "rank", "doc_id", "score")


def term_judgements(index: Bm25Index, qterms: DataFrame) -> DataFrame:
    """``(query_id, doc_id, gain)`` of pairs with a gain, from the postings."""
    terms = qterms.where(F.length("term") > 0).select(
        "query_id", "term", term_bucket("term", index.stats.n_buckets).alias("tbucket"))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    terms, _, _ = bounded_broadcast(terms)
    met = index.postings.select("tbucket", "term", "doc_id").join(terms, ["tbucket", "term"])
    held = met.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("_held"))
    share = F.col("_held") / F.col("_n")
    gain = F.when(share >= 1, FULL_GAIN).when(share >= PART_SHARE, PART_GAIN)
    return held.join(bounded_broadcast(sizes)[0], "query_id").select(
        "query_id", "doc_id", gain.alias("gain")).where(F.col("gain").isNotNull())


def relevance_at_k(runs: DataFrame, judged: DataFrame, query_ids: DataFrame,
                   methods: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """``(method, k, n_judged, precision, recall, ndcg)`` of ``runs(method,
    query_id, rank, doc_id)`` against ``judged(query_id, doc_id, gain)``."""
    # Rows of equal gain add the same wherever they stand, so an ideal list needs
    # the number of rows of each gain alone: no judgement crosses a shuffle.
    per_gain = judged.groupBy("query_id", "gain").agg(F.count(F.lit(1)).alias("n"))
    total = per_gain.groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    k_of = F.explode(F.array(*[F.lit(int(k)) for k in ks]))
    above = Window.partitionBy("query_id").orderBy(F.col("gain").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(above), F.lit(0)) + 1
    last = F.least(F.col("_first") + F.col("n") - 1, F.lit(max(ks)).cast("long"))
    placed = per_gain.withColumn("_first", first).where(F.col("_first") <= max(ks)).select(
        "query_id", "gain", F.explode(F.sequence("_first", last)).alias("_place"))
    ideal = placed.withColumn("k", k_of).where("_place <= k").groupBy("query_id", "k").agg(
        F.sum(F.col("gain") / F.log2(F.col("_place") + 1)).alias("ideal"))
    listed, _, _ = bounded_broadcast(runs)
    hits = judged.join(listed, ["query_id", "doc_id"]).withColumn("k", k_of).where("rank <= k")
    found = hits.groupBy("method", "query_id", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    grid = query_ids.select("query_id").withColumn(
        "method", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn("k", k_of)
    full = grid.join(found, ["method", "query_id", "k"], "left").join(
        total, "query_id", "left").join(ideal, ["query_id", "k"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.groupBy("method", "k").agg(
        F.count("n_relevant").alias("n_judged"), F.avg(n / F.col("k")).alias("precision"),
        F.avg(F.when(F.col("n_relevant").isNotNull(), n / F.col("n_relevant"))).alias("recall"),
        F.avg(F.when(F.col("ideal").isNotNull(), F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")))
        .alias("ndcg"))


def rerank(ranked: DataFrame, queries: DataFrame, texts: DataFrame, scorer, k: int) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: rows of ``ranked`` by ``scorer``.

    ``scorer()`` is called once per Python worker and returns a function of two
    lists, queries and texts, that gives their scores. ``ranked`` holds some
    rows per query; only their texts are fetched.
    """
    ship_package(ranked.sparkSession)
    pairs = ranked.select("query_id", "doc_id").join(queries.select("query_id", "query"), "query_id")
    small, _, _ = bounded_broadcast(pairs)
    met = texts.select("doc_id", "text").join(small, "doc_id")

    def run(batches):
        own = scorer()
        for pdf in batches:
            score = own(pdf["query"].fillna("").tolist(), pdf["text"].fillna("").tolist())
            yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"],
                                "score": pd.Series(score, dtype="float64")})

    types = dict(pairs.dtypes)
    scored = met.select("query_id", "doc_id", "query", "text").mapInPandas(
        run, f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double")
    return rank_top_k(scored, k, "score").select("query_id", "rank", "doc_id", "score")


def overlap_scorer():
    """A stand-in scorer: distinct words of the query in the text, as a share of
    the distinct words of both."""
    import regex

    word = regex.compile(r"[\p{L}\p{N}_]+")

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set(word.findall(q.lower())), set(word.findall(t.lower()))
            out.append(len(a & b) / len(a | b) if a | b else 0.0)
        return out

    return score

