"""BM25 fixtures: expected values computed by direct Python over all documents
(FIXTURES.md §3.2); analyzer without stop words or lemmas."""

import math

import pytest

from quarry.operators.analyze import Analyzer, query_terms
from quarry.operators.bm25 import text_top_k
from quarry.operators.index import build_index

NO_STOP = Analyzer(lists=())


def corpus(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text_processed string")


def search(spark, docs, query, k, tmp):
    idx = build_index(corpus(spark, docs), path=tmp + "/idx", n_parts=3)
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    rows = text_top_k(idx, q, query_terms(q, NO_STOP), k).orderBy("rank").collect()
    return idx, [(r["doc_id"], r["raw"], r["score"]) for r in rows]


TINY = {1: "a b c", 2: "a b", 3: "a b d", 4: "e", 5: ""}


def check(rows, expected):
    assert [r[0] for r in rows] == [e[0] for e in expected]
    for (doc, raw, score), (edoc, eraw, escore) in zip(rows, expected):
        assert raw == pytest.approx(eraw, abs=1e-9)
        assert score == pytest.approx(escore, abs=1e-6)


def test_tiny_stats(spark, tmp_out):
    idx = build_index(corpus(spark, TINY), path=tmp_out + "/idx", n_parts=2)
    assert idx.stats.n_docs == 5
    assert idx.stats.avg_idf == pytest.approx(0.524578479, abs=1e-9)
    assert idx.stats.avgdl == pytest.approx(9 / 5)
    docs = {r["doc_id"]: (r["doc_ord"], r["dl"]) for r in idx.docs.collect()}
    assert docs == {1: (0, 3), 2: (1, 2), 3: (2, 3), 4: (3, 1), 5: (4, 0)}


def test_tiny_single_term_epsilon_floor_and_padding(spark, tmp_out):
    _, rows = search(spark, TINY, "a", 4, tmp_out)
    check(rows, [(2, 0.124899638, 1.0), (1, 0.100880477, 0.807692),
                 (3, 0.100880477, 0.807692), (4, 0.0, 0.0)])


def test_tiny_two_terms(spark, tmp_out):
    _, rows = search(spark, TINY, "b c", 4, tmp_out)
    check(rows, [(1, 0.945966853, 1.0), (2, 0.124899638, 0.132034),
                 (3, 0.100880477, 0.106643), (4, 0.0, 0.0)])


def test_tiny_padding_after_single_hit(spark, tmp_out):
    _, rows = search(spark, TINY, "e", 4, tmp_out)
    check(rows, [(4, 1.373265361, 1.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)])


def test_unknown_term_gives_zero_list(spark, tmp_out):
    _, rows = search(spark, TINY, "q", 4, tmp_out)
    check(rows, [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)])


def test_repeated_query_term(spark, tmp_out):
    _, rows = search(spark, TINY, "e e", 4, tmp_out)
    check(rows, [(4, 2.746530722, 1.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)])


def test_k_larger_than_corpus(spark, tmp_out):
    _, rows = search(spark, TINY, "a", 20, tmp_out)
    assert sorted(r[0] for r in rows) == [1, 2, 3, 4, 5]


def test_negative_top_score_flips_normalised_order(spark, tmp_out):
    neg = {1: "a b", 2: "a b", 3: "a b", 4: "a b a", 5: "a"}
    idx, rows = search(spark, neg, "a", 5, tmp_out)
    assert idx.stats.avg_idf == pytest.approx(-1.748253781, abs=1e-9)
    check(rows, [(1, -0.437063445, 1.0), (2, -0.437063445, 1.0), (3, -0.437063445, 1.0),
                 (4, -0.537924240, 1.230769), (5, -0.563952832, 1.290323)])


def test_zero_score_document_ranks_above_negative_hits(spark, tmp_out):
    mixed = {1: "a b", 2: "a b", 3: "a b", 4: "a", 5: "b"}
    idx, rows = search(spark, mixed, "a", 3, tmp_out)
    assert idx.stats.avg_idf == pytest.approx(-1.098612289, abs=1e-9)
    check(rows, [(5, 0.0, 0.0), (1, -0.246879166, -0.246879166),
                 (2, -0.246879166, -0.246879166)])


def test_direct_formula_on_random_corpus(spark, tmp_out):
    """Against a direct all-documents computation, with ties by doc id."""
    import random

    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    docs = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12)))
            for i in range(1, 80)}
    query = "w1 w2 w3 w2 w29"
    k = 10
    _, rows = search(spark, docs, query, k, tmp_out)

    toks = {d: t.split() for d, t in docs.items()}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf0 = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    avg = sum(idf0.values()) / len(idf0)
    idf = {w: (v if v >= 0 else 0.25 * avg) for w, v in idf0.items()}
    scores = {}
    for d, t in toks.items():
        s = 0.0
        for q in query.split():
            tf = t.count(q)
            s += idf.get(q, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
        scores[d] = s
    expected = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    top = expected[0][1]
    check(rows, [(d, s, s / top if top != 0 else s) for d, s in expected])


def test_term_buckets_do_not_change_results(spark, tmp_out):
    """Several term partitions (pruned per batch) give the same lists as one."""
    import random

    rnd = random.Random(11)
    vocab = [f"t{i}" for i in range(40)]
    docs = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 15)))
            for i in range(1, 120)}
    q = spark.createDataFrame([(1, "t1 t2 t3"), (2, "t39"), (3, "zz"), (4, "t5 t5 t7")],
                              "query_id long, query string")
    out = []
    for buckets in (1, 4):
        idx = build_index(corpus(spark, docs), path=f"{tmp_out}/idx{buckets}", n_parts=3,
                          n_buckets=buckets)
        assert idx.stats.n_buckets == buckets
        rows = text_top_k(idx, q, query_terms(q, NO_STOP), 6).collect()
        out.append(sorted((r["query_id"], r["rank"], r["doc_id"], round(r["raw"], 9))
                          for r in rows))
    assert out[0] == out[1]
