"""Method evaluation over ranked lists.

Input ``runs(method, query_id, rank, score)``: the ranked lists of all
methods, fetched once at the largest cut-off. Every cut-off k is a prefix
``rank <= k`` of the same list (one pass: the k values are exploded).

* F2: mean score of the top k per query, 0 for a query without results;
* F3: mean of F2 over all queries;
* F4: max and min over all top-k scores of the method, 0 when there are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import snippet

# --- fixed values -----------------------------------------------------------
DEFAULT_KS = (1, 3, 5, 10)
# --- end of fixed values ----------------------------------------------------


def _grid(query_ids: DataFrame, methods: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Every (method, k, query): generated rows, not a join."""
    return (query_ids
            .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
            .withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))))


def metrics_at_k(runs: DataFrame, query_ids: DataFrame, methods: Sequence[str],
                 ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """``(method, k, avg_score, max_score, min_score)``."""
    prefixes = (runs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
                .where(F.col("rank") <= F.col("k")))
    per_query = prefixes.groupBy("method", "k", "query_id").agg(
        F.avg("score").alias("q_avg"), F.max("score").alias("q_max"),
        F.min("score").alias("q_min"))
    full = _grid(query_ids.select("query_id"), methods, ks).join(
        per_query, ["method", "k", "query_id"], "left")
    return full.groupBy("method", "k").agg(
        F.avg(F.coalesce("q_avg", F.lit(0.0))).alias("avg_score"),
        F.coalesce(F.max("q_max"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.min("q_min"), F.lit(0.0)).alias("min_score"))


def top_documents(runs: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """H5: the rank-1 document of every (method, query) with a title snippet
    (first 50 characters and ``...``)."""
    first = runs.where(F.col("rank") == 1).select("method", "query_id", "doc_id", "score")
    titles = corpus.select(F.col(key).alias("doc_id"), snippet("title", 50).alias("title"))
    return titles.join(first, "doc_id").select(
        "method", "query_id", "doc_id", "score", "title")


def first_query_examples(runs: DataFrame, query_ids: DataFrame, corpus: DataFrame,
                         n: int = 3, key: str = "doc_id") -> DataFrame:
    """H5: the top ``n`` rows of the first query (smallest id) per method, with
    the title and a summary snippet (first 100 characters and ``...``)."""
    first_id = query_ids.agg(F.min("query_id").alias("query_id"))
    rows = runs.join(F.broadcast(first_id), "query_id").where(F.col("rank") <= F.lit(n))
    payload = corpus.select(F.col(key).alias("doc_id"), "title",
                            snippet("summary", 100).alias("summary"))
    return payload.join(F.broadcast(rows), "doc_id").select(
        "method", "query_id", "rank", "doc_id", "score", "title", "summary")


def latency_summary(timings: DataFrame) -> DataFrame:
    """``timings(method, k, run, seconds_per_query)`` -> mean and population
    standard deviation per method and cut-off."""
    return timings.groupBy("method", "k").agg(
        F.avg("seconds_per_query").alias("avg_time"),
        F.stddev_pop("seconds_per_query").alias("std_time"))


def mean_latency(summary: DataFrame) -> DataFrame:
    """``(method, avg_time, std_time)``, the means of F5 over the cut-offs."""
    return summary.groupBy("method").agg(F.avg("avg_time").alias("avg_time"),
                                         F.avg("std_time").alias("std_time"))


def counts(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """number of documents and of queries (one row)."""
    tagged = corpus.select(F.lit(0).alias("_t")).unionByName(queries.select(F.lit(1).alias("_t")))
    return tagged.agg(F.count_if(F.col("_t") == 0).alias("n_documents"),
                      F.count_if(F.col("_t") == 1).alias("n_queries"))
