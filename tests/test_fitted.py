import numpy as np
import pytest
import regex

from quarry.functions.text import TOKEN_PATTERN
from quarry.operators.encoder import encode
from quarry.operators.fitted import WORD_PATTERN, Rows, fit_encoder, hashed, weighted, words
from quarry.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

COLUMNS, RANK = 512, 24


def dense(texts):
    """The hashed document-term matrix by its definition."""
    lists = [words(regex.findall(TOKEN_PATTERN, (t or "").lower())) for t in texts]
    counts = np.zeros((len(texts), COLUMNS))
    touched = np.zeros((len(texts), COLUMNS), bool)
    for i, terms in enumerate(lists):
        for t in set(terms):
            at, sign = hashed(t, COLUMNS)
            counts[i, at] += sign * np.log1p(terms.count(t))
            touched[i, at] = True
    idf = np.log((1 + len(texts)) / (1 + touched.sum(0))) + 1
    a = counts * idf
    norm = np.sqrt((a ** 2).sum(1, keepdims=True))
    return a / np.where(norm > 0, norm, 1)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def encoder(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    return fit_encoder(df, rank=RANK, columns=COLUMNS, passes=6)


def test_against_a_dense_svd(documents, encoder):
    a = dense([t for _, t in documents])
    values = np.linalg.svd(a, compute_uv=False)
    assert encoder.values[:8] == pytest.approx(values[:8], rel=1e-3)
    assert encoder.vectors.T @ encoder.vectors == pytest.approx(np.eye(RANK), abs=1e-9)
    # The vectors catch nearly all that any vectors of that rank could.
    assert (np.linalg.norm(a @ encoder.vectors) ** 2) >= 0.995 * (values[:RANK] ** 2).sum()


def test_encoded_rows_are_the_projected_ones(spark, documents, encoder):
    rows = documents[:50] + [(-1, None), (-2, ""), (-3, "!!! ...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: np.array(r["embedding"]) for r in encode(df, encoder).collect()}
    # IDF weights are those of the corpus that was fitted.
    lists = [words(regex.findall(TOKEN_PATTERN, (t or "").lower())) for _, t in rows]
    want = Rows(encoder.idf, COLUMNS).times(lists, encoder.vectors)
    for (i, _), w in zip(rows, want, strict=True):
        n = np.linalg.norm(w)
        assert got[i] == pytest.approx(w / n if n > 0 else w, abs=1e-5)
    assert not got[-1].any() and not got[-3].any()


def test_all_letters_count(encoder):
    run = encoder()
    assert np.abs(run(["новости города", "über größe", "漢字"])).sum(1).min() > 0


def test_partitions_do_not_matter(spark, documents, encoder):
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(2)
    again = fit_encoder(df, rank=RANK, columns=COLUMNS, passes=6)
    assert again.values[:8] == pytest.approx(encoder.values[:8], rel=1e-6)


def test_empty_corpus(spark):
    none = fit_encoder(spark.createDataFrame([], "doc_id long, text string"), rank=4, columns=64)
    assert not none()(["a b c"]).any()


def test_registered_queries(spark):
    rows = QUERIES["encode_documents_fitted"](spark, SF_SMALL).collect()
    assert len(rows) == 200
    norms = {round(float(np.linalg.norm(r["embedding"])), 3) for r in rows}
    assert norms <= {0.0, 1.0}
    found = QUERIES["vector_search_fitted"](spark, SF_SMALL).collect()
    assert {r["rank"] for r in found} == set(range(1, 11))


def test_rows_are_hashed_once_for_all_rounds(spark):
    texts = ["a b a", "", "c", "b c d e b"]
    lists = [t.split() for t in texts]
    df = spark.createDataFrame([(t,) for t in lists], "terms array<string>").coalesce(1)
    plain = Rows(None, 8)
    got = weighted(df, 8).collect()
    for r, terms in zip(got, lists, strict=True):
        at, weight = plain.weights(terms)
        assert r["at"] == at.tolist() and r["weight"] == weight.tolist()
    rows = regex.findall(TOKEN_PATTERN, "3.5 «a-b» ... x.y_1's 7 — é! 2,000.5.")
    assert regex.findall(WORD_PATTERN, "3.5 «a-b» ... x.y_1's 7 — é! 2,000.5.") == words(rows)
