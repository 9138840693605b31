"""Fusion (FIXTURES.md §3.4) and vector (§3.5) fixtures."""

import numpy as np
import pytest

from quarry.functions.vectors import dot, l2_normalize
from quarry.operators.encoder import HashingEncoder, encode
from quarry.operators.fusion import fuse, fused_top_k
from quarry.operators.vector import document_vectors, vector_top_k
from quarry.params import check_weights

IDS = {c: i for i, c in enumerate("ABCDEFG")}
NAMES = {i: c for c, i in IDS.items()}


def ranked(spark, items, depth):
    rows = [(1, r + 1, IDS[d], s) for r, (d, s) in enumerate(items) if r < depth]
    return spark.createDataFrame(rows, "query_id long, rank int, doc_id long, score double")


def hybrid(spark, text, vector, k, weights=None):
    depth = 2 * k
    f = fuse(ranked(spark, text, depth), ranked(spark, vector, depth), check_weights(weights))
    out = fused_top_k(f, k).orderBy("rank").collect()
    return [(NAMES[r["doc_id"]], r["score"], r["score_type"]) for r in out]


TEXT = [("A", 1.0), ("B", 0.9), ("C", 0.8), ("D", 0.7)]
VEC = [("E", 0.60), ("F", 0.59), ("D", 0.58), ("G", 0.10)]


def test_top1_depends_on_depth(spark):
    assert hybrid(spark, TEXT, VEC, 1) == [("A", 0.5, "bm25")]
    assert hybrid(spark, TEXT, VEC, 2) == [("D", 0.64, "hybrid"), ("A", 0.5, "bm25")]


def test_tie_order_text_first_then_vector_rank(spark):
    out = hybrid(spark, [("A", 1.0), ("B", 0.6)], [("C", 0.6), ("D", 0.6)], 3)
    assert out == [("A", 0.5, "bm25"), ("B", 0.3, "bm25"), ("C", 0.3, "vector")]


def test_duplicate_key_in_one_list_keeps_best(spark):
    text = ranked(spark, [("A", 1.0)], 2)
    vec = spark.createDataFrame([(1, 1, 0, 0.5), (1, 2, 0, 0.4)],
                                "query_id long, rank int, doc_id long, score double")
    out = fused_top_k(fuse(text, vec, check_weights(None)), 1).collect()
    assert [(r["doc_id"], r["score"], r["score_type"]) for r in out] == [(0, 0.75, "hybrid")]


def test_weights_one_zero_reproduce_text_order(spark):
    out = hybrid(spark, TEXT, VEC, 2, {"bm25": 1.0, "vector": 0.0})
    assert [o[0] for o in out] == ["A", "B"]


def vecs(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


DOCS = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])]


def test_vector_top_k_unit_vectors(spark):
    out = vector_top_k(vecs(spark, DOCS, "doc_id"), vecs(spark, [(9, [1.0, 0.0])], "query_id"),
                       2).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in out] == [(1, 1.0), (3, 0.6)]


def test_vector_k_larger_than_corpus_returns_fewer_rows(spark):
    out = vector_top_k(vecs(spark, DOCS, "doc_id"), vecs(spark, [(9, [1.0, 0.0])], "query_id"),
                       10).collect()
    assert len(out) == 3


def test_vector_without_document_dropped(spark):
    emb = vecs(spark, DOCS + [(4, [1.0, 0.0])], "doc_id")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    kept = sorted(r["doc_id"] for r in document_vectors(emb, docs).collect())
    assert kept == [1, 2, 3]


def test_block_path_equals_broadcast_path(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(60, 8)).astype(np.float32)
    q = rng.normal(size=(25, 8)).astype(np.float32)
    dv = vecs(spark, [(i, d[i].tolist()) for i in range(60)], "doc_id").repartition(4)
    qv = vecs(spark, [(100 + j, q[j].tolist()) for j in range(25)], "query_id")
    a = vector_top_k(dv, qv, 5).collect()
    b = vector_top_k(dv, qv, 5, max_query_bytes=8 * 8 * 4).collect()   # forces 7 query blocks
    key = lambda r: (r["query_id"], r["rank"])
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in sorted(a, key=key)] == \
           [(r["query_id"], r["rank"], r["doc_id"]) for r in sorted(b, key=key)]
    # against numpy
    s = q.astype(np.float64) @ d.astype(np.float64).T
    for r in a:
        row = s[r["query_id"] - 100]
        order = sorted(range(60), key=lambda i: (-np.floor(row[i] * 1e9 + 0.5), i))
        assert order[r["rank"] - 1] == r["doc_id"]


def test_ties_broken_by_doc_id(spark):
    dv = vecs(spark, [(i, [1.0, 0.0]) for i in range(30, 0, -1)], "doc_id").repartition(3)
    out = vector_top_k(dv, vecs(spark, [(9, [1.0, 0.0])], "query_id"), 4).orderBy("rank")
    assert [r["doc_id"] for r in out.collect()] == [1, 2, 3, 4]


def test_l2_normalize_and_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    out = [r["u"] for r in df.select(l2_normalize("v").alias("u")).collect()]
    assert out[0] == pytest.approx([0.6, 0.8])
    assert out[1] == [0.0, 0.0]


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(dot("a", "b").alias("d")).first()["d"] == 11.0


def test_encoder_hook_unit_rows(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: np.array(r["embedding"]) for r in
           encode(df, HashingEncoder(16)).collect()}
    assert np.linalg.norm(out[1]) == pytest.approx(1.0, abs=1e-6)
    assert np.linalg.norm(out[2]) == 0.0 and np.linalg.norm(out[3]) == 0.0


VEC_SCHEMA = "doc_id long, embedding array<float>"
QUERY_SCHEMA = "query_id long, embedding array<float>"


@pytest.mark.parametrize("limit", [1 << 20, 8])
@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [float("inf"), 0.0], [1.0, None], [1.0]])
def test_bad_document_vectors_raise(spark, bad, limit):
    docs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)] + [(99, bad)], VEC_SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.1, 0.5])], QUERY_SCHEMA)
    with pytest.raises(Exception, match="component"):
        vector_top_k(docs, queries, 5, max_query_bytes=limit).collect()


def test_query_vectors_of_another_length_raise(spark):
    docs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], VEC_SCHEMA)
    for rows in ([(1, [1.0, 0.5]), (2, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0, 3.0])]):
        queries = spark.createDataFrame(rows, QUERY_SCHEMA)
        with pytest.raises(ValueError, match="components"):
            vector_top_k(docs, queries, 5)
    none = spark.createDataFrame([(1, None), (2, [])], QUERY_SCHEMA)
    assert vector_top_k(docs, none, 5).count() == 0


def test_documents_of_one_url_are_one_row(spark):
    from quarry.operators.fusion import url_aliases

    corpus = spark.createDataFrame(
        [(IDS[c], u) for c, u in zip("ABCDEFG", ["u1", "u1", "u2", "u3", None, "", "u3"])],
        "doc_id long, url string")
    aliases = url_aliases(corpus)
    assert sorted(map(tuple, aliases.collect())) == [(IDS["B"], IDS["A"]), (IDS["G"], IDS["D"])]
    f = fuse(ranked(spark, TEXT, 8), ranked(spark, VEC, 8), check_weights(None), aliases)
    out = [(NAMES[r["doc_id"]], r["score"], r["score_type"])
           for r in fused_top_k(f, 9).orderBy("rank").collect()]
    assert out == [("D", 0.64, "hybrid"), ("A", 0.5, "bm25"), ("C", 0.4, "bm25"),
                   ("E", 0.3, "vector"), ("F", 0.295, "vector")]


def test_encoder_key_is_by_content():
    from quarry.operators.encoder import encoder_key

    keys = {encoder_key(lambda n=n: (lambda texts: np.full((len(texts), 2), n))) for n in range(50)}
    assert len(keys) == 50
    assert encoder_key(HashingEncoder(8)) == encoder_key(HashingEncoder(8)) != encoder_key(HashingEncoder(9))


def test_numbers_and_ellipsis_are_one_token(spark):
    from pyspark.sql import functions as F

    from quarry.functions.text import tokenize

    row = spark.range(1).select(tokenize(F.lit("10,5 x... v1.2 a, b 3,x")).alias("t")).first()
    assert row["t"] == ["10,5", "x", "...", "v1.2", "a", ",", "b", "3", ",", "x"]
