"""BM25 scoring of a whole query table against an index (D5, D6, E1, G1,
G2, H1).

Plan of :func:`text_top_k`:

1. ``hits``: query terms get their IDF from the term table and (broadcast
   when their size is within bounds) join the postings on ``(tbucket, term)``;
   ``sum(qtf * idf * part)`` per (query, document). Only postings of query terms are read (dynamic partition
   pruning on the term bucket), and since postings are bucketed by document
   the sum is complete inside each task: no shuffle of (query, document)
   pairs, however many documents a query hits.
2. ``row_number`` per query over ``(score key desc, doc_id asc)`` with
   ``rank <= k``; Spark plans a partial per-task top-k before the shuffle
   (``WindowGroupLimit``), so even a query that hits a third of the corpus
   ships k rows per task.
3. Zero-score padding: every document has a score, 0 when it holds none of
   the terms. A query with fewer than k positive hits is *short*; its free
   places go to the zero-score documents with the smallest keys.
   * No negative weight (``epsilon * avg_idf >= 0``, any corpus of realistic
     size): all positive hits of a short query are in its top-k list, so the
     top-k list is merged with the first k documents of the key order at
     score 0, keeping the larger score per document (:func:`first_docs_pad`).
     A positive hit outside the list cannot displace anything: the list then
     holds k positive rows. The hits are evaluated once.
   * Otherwise (tiny corpora whose mean IDF is negative): with
     ``m = k - positives`` and ``x`` hits of non-zero score, the free places
     lie among the first ``m + x`` positions; exactly that range is generated
     in chunks spread over tasks and the hits are removed
     (:func:`pad_candidates`). No cross join in either case.
4. Scores are divided by the query's top score unless that is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import rank_key
from quarry.operators.index import Bm25Index, term_bucket
from quarry.session import BROADCAST_ROW_LIMIT, bounded_broadcast

PAD_CHUNK = 65_536


def bm25_hits(index: Bm25Index, qterms: DataFrame,
              max_broadcast_rows: int = BROADCAST_ROW_LIMIT,
              broadcast_terms: bool | None = None) -> DataFrame:
    """D5 + E1: ``(query_id, doc_id, raw)`` for documents holding at least one
    query term.

    ``broadcast_terms``: the caller's size decision for the query terms; when
    ``None`` their rows are counted here against ``max_broadcast_rows``.
    """
    qt = (qterms.where(F.length("term") > 0)
          .withColumn("tbucket", term_bucket("term", index.stats.n_buckets)))
    qt = qt.where(F.col("query_id").isNotNull()).join(
        index.terms.select("tbucket", "term", "idf"), ["tbucket", "term"])
    if broadcast_terms is None:
        qt, _, _ = bounded_broadcast(qt, max_broadcast_rows)
    elif broadcast_terms:
        qt = F.broadcast(qt)
    # Explicit null filters: every consumer of the hits (ranking, counts,
    # anti join) then plans the identical subtree and the exchange is reused.
    postings = index.postings.where(F.col("doc_id").isNotNull())
    joined = postings.join(qt, ["tbucket", "term"])
    return (joined.groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("qtf").cast("double") * (F.col("idf") * F.col("part"))).alias("raw")))


def pad_candidates(index: Bm25Index, query_ids: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Zero-score rows that may enter the top ``k`` of short queries:
    ``(query_id, doc_id, raw = 0.0)``."""
    keyed = hits.withColumn("key", rank_key("raw"))
    counts = keyed.groupBy("query_id").agg(
        F.count_if(F.col("key") > 0).alias("n_pos"),
        F.count_if(F.col("key") != 0).alias("n_nonzero"))
    short = (query_ids.join(counts, "query_id", "left")
             .select("query_id",
                     F.least(F.lit(index.stats.n_docs).cast("long"),
                             F.lit(k) - F.coalesce("n_pos", F.lit(0))
                             + F.coalesce("n_nonzero", F.lit(0))).alias("span"),
                     F.coalesce("n_pos", F.lit(0)).alias("n_pos"))
             .where((F.col("n_pos") < k) & (F.col("span") > 0)))
    chunks = (short.select("query_id", "span",
                           F.explode(F.sequence(F.lit(0).cast("long"),
                                                F.floor((F.col("span") - 1) / PAD_CHUNK))).alias("chunk"))
              .repartition("query_id", "chunk"))
    ords = chunks.select(
        "query_id",
        F.explode(F.sequence(F.col("chunk") * PAD_CHUNK,
                             F.least(F.col("span"), (F.col("chunk") + 1) * PAD_CHUNK) - 1))
        .alias("doc_ord"))
    pads = ords.join(index.docs.select("doc_ord", "doc_id"), "doc_ord")
    pads = pads.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return pads.select("query_id", "doc_id", F.lit(0.0).alias("raw"))


def first_docs_pad(index: Bm25Index, query_ids: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, raw = 0.0)`` for the first ``k`` documents in key
    order, for every query (an equi-join on the position; the document side
    is a pushed-down range filter of at most ``k`` rows)."""
    first = index.docs.where(F.col("doc_ord") < k).select("doc_ord", "doc_id")
    ords = query_ids.select("query_id", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("doc_ord"))
    return ords.join(F.broadcast(first), "doc_ord").select(
        "query_id", "doc_id", F.lit(0.0).alias("raw"))


def rank_top_k(scored: DataFrame, k: int, score: str = "raw") -> DataFrame:
    """G1 + H1: ``rank`` 1..k per query by (score key desc, doc_id asc)."""
    w = Window.partitionBy("query_id").orderBy(F.col("_key").desc(), F.col("doc_id").asc())
    return (scored.withColumn("_key", rank_key(score))
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(k))
            .drop("_key"))


def normalize_by_top(ranked: DataFrame, raw: str = "raw", out: str = "score") -> DataFrame:
    """D6 + G2: divide by the query's maximum unless that maximum is 0."""
    top = F.max(raw).over(Window.partitionBy("query_id"))
    return ranked.withColumn(out, F.when(top != 0, F.col(raw) / top).otherwise(F.col(raw)))


def text_top_k(index: Bm25Index, queries: DataFrame, qterms: DataFrame, k: int,
               pad: bool = True, max_broadcast_rows: int = BROADCAST_ROW_LIMIT,
               broadcast_terms: bool | None = None) -> DataFrame:
    """J1 core: ``(query_id, rank, doc_id, raw, score)``, at most k rows per query."""
    hits = bm25_hits(index, qterms, max_broadcast_rows, broadcast_terms)
    query_ids = queries.select("query_id")
    if not pad:
        ranked = rank_top_k(hits, k)
    elif index.stats.epsilon * index.stats.avg_idf >= 0:
        # No negative weight: merge each k-row list with the first k
        # documents (score 0) and keep the larger score per document.
        top = rank_top_k(hits, k).select("query_id", "doc_id", "raw")
        # One exchange by query serves both windows: the per-(query,
        # document) dedupe and the ranking (clustering on query_id satisfies
        # both); every partition holds at most 2k rows per query.
        merged = (top.unionByName(first_docs_pad(index, query_ids, k))
                  .repartition("query_id"))
        per_doc = Window.partitionBy("query_id", "doc_id").orderBy(F.col("raw").desc())
        deduped = (merged.withColumn("_n", F.row_number().over(per_doc))
                   .where(F.col("_n") == 1).drop("_n"))
        ranked = rank_top_k(deduped, k)
    else:
        ranked = rank_top_k(hits.unionByName(pad_candidates(index, query_ids, hits, k)), k)
    return normalize_by_top(ranked).select("query_id", "rank", "doc_id", "raw", "score")
