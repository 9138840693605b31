import math

import pytest

from quarry.operators.index import build_index
from quarry.operators.relevance import (FULL_GAIN, PART_GAIN, overlap_scorer,
                                        reciprocal_rank_fusion, relevance_at_k, rerank,
                                        term_judgements)


def test_reciprocal_rank_fusion(spark):
    schema = "query_id long, rank int, doc_id long"
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 5)], schema)
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], schema)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"])
           for r in reciprocal_rank_fusion([a, b], 2).collect()}
    assert got[1, 1] == (11, pytest.approx(1 / 62 + 1 / 61))
    assert got[1, 2] == (10, pytest.approx(1 / 61)) and got[2, 1] == (5, pytest.approx(1 / 61))


def test_judgements_from_postings(spark):
    corpus = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a"), (4, "")],
                                   "doc_id long, text_processed string")
    index = build_index(corpus)
    qterms = spark.createDataFrame([(9, t, 1) for t in "abc"], "query_id long, term string, qtf long")
    got = {r["doc_id"]: r["gain"] for r in term_judgements(index, qterms).collect()}
    assert got == {1: FULL_GAIN, 2: PART_GAIN}


def test_metrics_against_the_definition(spark):
    runs = spark.createDataFrame(
        [("m", 1, 1, 10), ("m", 1, 2, 11), ("m", 1, 3, 12), ("m", 2, 1, 20), ("m", 3, 1, 30)],
        "method string, query_id long, rank int, doc_id long")
    judged = spark.createDataFrame([(1, 11, 3), (1, 12, 1), (1, 99, 1), (2, 20, 1)],
                                   "query_id long, doc_id long, gain int")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    got = {(r["method"], r["k"]): r for r in
           relevance_at_k(runs, judged, ids, ("m", "none"), (1, 3)).collect()}
    r = got["m", 3]
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    dcg = 3 / math.log2(3) + 1 / 2
    assert r["n_judged"] == 2
    assert r["precision"] == pytest.approx((2 / 3 + 1 / 3 + 0 + 0) / 4)
    assert r["recall"] == pytest.approx((2 / 3 + 1) / 2)
    assert r["ndcg"] == pytest.approx((dcg / ideal + 1) / 2)
    assert got["m", 1]["ndcg"] == pytest.approx((0 + 1) / 2)
    assert (got["none", 3]["precision"], got["none", 3]["ndcg"]) == (0.0, 0.0)


def test_rerank_orders_by_the_scorer(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 12)],
                                   "query_id long, rank int, doc_id long")
    queries = spark.createDataFrame([(1, "red fox"), (2, None)], "query_id long, query string")
    texts = spark.createDataFrame([(10, "blue"), (11, "a red fox"), (12, None)],
                                  "doc_id long, text string")
    got = [(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 3))
           for r in rerank(ranked, queries, texts, overlap_scorer, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 11, 0.667), (1, 2, 10, 0.0), (2, 1, 12, 0.0)]


def test_ideal_lists_come_from_counts_of_gains(spark):
    judged = spark.createDataFrame([(1, d, 3 if d < 2 else 1) for d in range(7)] + [(2, 5, 1)],
                                   "query_id long, doc_id long, gain int")
    runs = spark.createDataFrame([("m", 1, 1, 0), ("m", 1, 2, 50), ("m", 1, 3, 4), ("m", 2, 1, 5)],
                                 "method string, query_id long, rank int, doc_id long")
    ids = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = relevance_at_k(runs, judged, ids, ("m",), (1, 3, 10))
    # No row number over the judgements of a query, however many it has.
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: r for r in found.collect()}
    gains = [3, 3, 1, 1, 1, 1, 1]
    for k in (1, 3, 10):
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(gains[:k]))
        dcg = 3 + (1 / 2 if k >= 3 else 0)
        assert got[k]["ndcg"] == pytest.approx((dcg / ideal + 1) / 2)
        assert got[k]["recall"] == pytest.approx(((2 if k >= 3 else 1) / 7 + 1) / 2)
