"""Method evaluation (J6): scores of every method at several cut-offs, top
documents and examples, counts, and (optionally) measured latency.

All methods run once over the whole query table at the largest cut-off;
cut-offs are prefixes of those lists. Hybrid lists depend on the requested
depth (candidates are fetched at ``depth_factor * top_k``), so the examples
run at their own ``top_k`` (3), as the evaluation design does.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.evaluate import (
    DEFAULT_KS,
    counts,
    first_query_examples,
    latency_summary,
    mean_latency,
    metrics_at_k,
    top_documents,
)
from quarry.operators.fusion import fuse, fused_top_k
from quarry.params import DEFAULT_DEPTH_FACTOR, METHODS, check_method, check_weights
from quarry.plans.search import SearchEngine
from quarry.session import scratch_path, write_parquet

EXAMPLE_TOP_K = 3


def method_runs(engine: SearchEngine, queries: DataFrame, query_vectors: DataFrame, k: int,
                methods: Sequence[str] = METHODS, weights: dict | None = None,
                depth_factor: int = DEFAULT_DEPTH_FACTOR) -> DataFrame:
    """``(method, query_id, rank, doc_id, score)`` for all methods.

    A ranked list at depth d holds the list at any k <= d as its prefix (the
    order is total and the text normaliser is the rank-1 score), so the text
    and vector lists are computed once, at the hybrid candidate depth when
    hybrid is asked for, and written as small tables (at most queries x depth
    rows each);
    every method reads them. Hybrid scores are the rounded (4 places) scores
    a caller sees.
    """
    spark = queries.sparkSession
    depth = depth_factor * k if "hybrid" in methods else k
    text = vector = None
    # Written once under the checkpoint directory (one computation each; a
    # reliable checkpoint of an uncached plan would compute it twice).
    if "text" in methods or "hybrid" in methods:
        text = write_parquet(engine.text_ranked(queries, depth),
                             scratch_path(spark, "runs-text"))
    if "vector" in methods or "hybrid" in methods:
        vector = write_parquet(engine.vector_ranked(query_vectors, depth),
                               scratch_path(spark, "runs-vector"))
    runs = None
    for m in methods:
        check_method(m)
        if m == "text":
            r = text.where(F.col("rank") <= k)
        elif m == "vector":
            r = vector.where(F.col("rank") <= k)
        else:
            r = fused_top_k(fuse(text, vector, check_weights(weights)), k)
        r = r.select(F.lit(m).alias("method"), "query_id", "rank", "doc_id", "score")
        runs = r if runs is None else runs.unionByName(r)
    return runs


def measure_latency(engine: SearchEngine, queries: DataFrame, query_vectors: DataFrame,
                    ks: Sequence[int], methods: Sequence[str] = METHODS, repeats: int = 3,
                    weights: dict | None = None) -> DataFrame:
    """F5 input: a run log, wall time per query of each method and cut-off, one
    row per repeat.

    Each repeat runs the whole query table as one job; the time per query is
    that wall time divided by the number of queries.
    """
    spark = queries.sparkSession
    n = max(1, queries.count())
    rows = []
    for m, k, r in product(methods, ks, range(repeats)):
        t0 = time.perf_counter()
        engine.ranked(m, queries, query_vectors, k, weights).write.format("noop").mode(
            "overwrite").save()
        rows.append((m, int(k), r, (time.perf_counter() - t0) / n))
    return spark.createDataFrame(
        rows, "method string, k int, run int, seconds_per_query double")


def evaluate(engine: SearchEngine, queries: DataFrame, query_vectors: DataFrame,
             ks: Sequence[int] = DEFAULT_KS, methods: Sequence[str] = METHODS,
             weights: dict | None = None, with_latency: bool = False,
             repeats: int = 3) -> dict[str, DataFrame]:
    """``metrics``, ``top_documents``, ``examples``, ``counts`` and, when
    asked, ``latency`` per method and k, its mean over k, and ``metrics``
    joined with it."""
    kmax = max(ks)
    runs = method_runs(engine, queries, query_vectors, kmax, methods, weights)
    metrics = metrics_at_k(runs, queries, methods, ks)
    example_runs = method_runs(engine, queries, query_vectors, EXAMPLE_TOP_K, methods, weights)
    out = {
        "metrics": metrics,
        "top_documents": top_documents(example_runs, engine.corpus, engine.key),
        "examples": first_query_examples(example_runs, queries, engine.corpus,
                                         EXAMPLE_TOP_K, engine.key),
        "counts": counts(engine.corpus, queries),
    }
    if with_latency:
        timings = measure_latency(engine, queries, query_vectors, ks, methods, repeats, weights)
        latency = latency_summary(timings)
        out["latency"], out["mean_latency"] = latency, mean_latency(latency)
        out["metrics"] = metrics.join(F.broadcast(latency), ["method", "k"], "left").withColumn(
            "evaluated_at", F.current_timestamp())
    return out
