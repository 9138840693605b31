import pytest

from quarry.operators.evaluate import counts, latency_summary, mean_latency, metrics_at_k


def test_metrics_prefixes_and_empty_queries(spark):
    runs = spark.createDataFrame(
        [("text", 1, 1, 10, 1.0), ("text", 1, 2, 11, 0.5), ("text", 1, 3, 12, 0.25),
         ("text", 2, 1, 10, 0.8)],
        "method string, query_id long, rank int, doc_id long, score double")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    m = {(r["method"], r["k"]): r for r in
         metrics_at_k(runs, queries, ("text", "vector"), (1, 3)).collect()}
    # k=1: per-query means 1.0, 0.8, 0 (no results) -> 0.6
    assert m[("text", 1)]["avg_score"] == pytest.approx(0.6)
    assert (m[("text", 1)]["max_score"], m[("text", 1)]["min_score"]) == (1.0, 0.8)
    # k=3: (1.75/3 + 0.8 + 0) / 3
    assert m[("text", 3)]["avg_score"] == pytest.approx((1.75 / 3 + 0.8) / 3)
    assert m[("text", 3)]["min_score"] == 0.25
    # a method without rows scores 0 everywhere
    assert (m[("vector", 3)]["avg_score"], m[("vector", 3)]["max_score"],
            m[("vector", 3)]["min_score"]) == (0.0, 0.0, 0.0)


def test_latency_population_std(spark):
    t = spark.createDataFrame([("text", 1, 0, 1.0), ("text", 1, 1, 3.0), ("text", 5, 0, 6.0)],
                              "method string, k int, run int, seconds_per_query double")
    summary = latency_summary(t)
    r = {x["k"]: (x["avg_time"], x["std_time"]) for x in summary.collect()}
    assert r == {1: (2.0, 1.0), 5: (6.0, 0.0)}
    assert tuple(mean_latency(summary).first()) == ("text", 4.0, 0.5)


def test_counts(spark):
    c = spark.createDataFrame([(1,), (2,)], "doc_id long")
    q = spark.createDataFrame([(1,)], "query_id long")
    r = counts(c, q).first()
    assert (r["n_documents"], r["n_queries"]) == (2, 1)
