"""Corpus and index build.

``build_corpus``: raw documents -> prepared corpus (cleaned fields and the
analysed ``*_processed`` strings), written once as Parquet. The text
analysis is the expensive part and runs once, spread over the cluster by
key.

``build_index``: prepared corpus -> BM25 tables (see
:mod:`quarry.operators.index`).

``build_vectors``: embeddings that have a document, written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import join_tokens, split_tokens
from quarry.operators.analyze import (DEFAULT_ANALYZER, Analyzer, lemmatize_columns,
                                      lemmatize_joined, prepare_documents)
from quarry.operators.index import Bm25Index, build_index
from quarry.operators.lemmas import LemmaGuesser
from quarry.operators.vector import document_vectors
from quarry.session import scratch_path, spread, write_parquet

PROCESSED_COLUMNS = ("title_processed", "summary_processed", "text_processed")

__all__ = ["build_corpus", "build_index", "build_vectors", "encode_corpus", "Bm25Index"]


def build_corpus(raw: DataFrame, path: str | None = None, analyzer: Analyzer = DEFAULT_ANALYZER,
                 key: str = "doc_id", lemmas: DataFrame | LemmaGuesser | None = None) -> DataFrame:
    """Prepare and persist the corpus; returns the written table."""
    spark = raw.sparkSession
    prepared = prepare_documents(spread(raw, key), analyzer, key)
    if lemmas is not None:
        prepared = with_lemmas(prepared, key, lemmas)
    # Texts, twice over, are most of what an engine writes: zstd takes a quarter off.
    return write_parquet(prepared, path or scratch_path(spark, "corpus"), codec="zstd")


def with_lemmas(prepared: DataFrame, key: str, lemmas: DataFrame | LemmaGuesser) -> DataFrame:
    """The prepared corpus with the lemmas of its analysed tokens."""
    joined = lemmatize_joined(prepared, list(PROCESSED_COLUMNS), lemmas)
    if joined is not None:
        return joined
    arrays = prepared.withColumns({c: split_tokens(c) for c in PROCESSED_COLUMNS})
    lemmatized = lemmatize_columns(arrays, key, list(PROCESSED_COLUMNS), lemmas)
    return lemmatized.withColumns({c: join_tokens(c) for c in PROCESSED_COLUMNS}).select(
        *prepared.columns)


def build_vectors(embeddings: DataFrame, corpus: DataFrame, path: str | None = None,
                  key: str = "doc_id") -> DataFrame:
    """Document vectors ``(doc_id, embedding)`` restricted to the corpus."""
    spark = corpus.sparkSession
    return write_parquet(document_vectors(embeddings, corpus, key),
                         path or scratch_path(spark, "vectors"))


def encode_corpus(corpus: DataFrame, encoder_factory, path: str | None = None,
                  key: str = "doc_id") -> DataFrame:
    """C1 inside J5: unit-length vectors of the basic-cleaned body ``text``
    of the prepared corpus, by the caller's encoder, written as Parquet."""
    from quarry.operators.encoder import encode

    spark = corpus.sparkSession
    vectors = encode(corpus.select(F.col(key).alias("doc_id"), "text"), encoder_factory,
                     text_col="text", key="doc_id")
    return write_parquet(vectors, path or scratch_path(spark, "vectors"))
