"""User-level search over whole query tables.

Each method takes a DataFrame of queries and returns one flat DataFrame
keyed ``(query_id, rank)``:

``query_id, rank, doc_id, title, summary, url, date, score`` (+ ``score_type``
for hybrid).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.analyze import DEFAULT_ANALYZER, Analyzer, query_terms
from quarry.operators.blockmax import Blocks, build_blocks, text_top_k_pruned
from quarry.operators.bm25 import text_top_k
from quarry.operators.fusion import fuse, fused_top_k
from quarry.operators.index import Bm25Index
from quarry.operators.lemmas import LemmaGuesser
from quarry.operators.payload import bucket_count, with_payload
from quarry.operators.vector import MAX_QUERY_BYTES, query_shape, vector_top_k
from quarry.session import BROADCAST_ROW_LIMIT, scratch_path, write_parquet
from quarry.params import (
    DEFAULT_DEPTH_FACTOR,
    check_method,
    check_top_k,
    check_weights,
)

RESULT_COLUMNS = ("query_id", "rank", "doc_id", "title", "summary", "url", "date", "score")


@dataclass
class SearchEngine:
    """A built corpus, its BM25 index and its document vectors."""

    corpus: DataFrame
    index: Bm25Index
    doc_vectors: DataFrame | None
    analyzer: Analyzer = DEFAULT_ANALYZER
    lemmas: DataFrame | LemmaGuesser | None = None
    key: str = "doc_id"
    max_query_bytes: int = MAX_QUERY_BYTES
    encoder: object | None = field(default=None, repr=False)
    payload: DataFrame | None = None   # narrow, by key bucket (build_payload)
    aliases: DataFrame | None = None   # (doc_id, merge_id) of shared URLs (url_aliases)
    payload_buckets: int | None = None
    blocks: Blocks | None = field(default=None, repr=False)   # built by the first pruned search

    def __post_init__(self) -> None:
        if self.payload is not None and self.payload_buckets is None:
            self.payload_buckets = bucket_count(self.payload)

    def _payload(self, ranked: DataFrame, rows: int, columns) -> DataFrame:
        """Payload join of ranked rows; ``rows`` bounds their count."""
        table = self.payload if self.payload is not None else self.corpus
        key = "doc_id" if self.payload is not None else self.key
        return with_payload(ranked, table, key, small_results=self._small(rows),
                            n_buckets=self.payload_buckets).select(*columns)

    # -- size checks -------------------------------------------------------
    def query_bounds(self, queries: DataFrame) -> tuple[int, int]:
        """``(queries, analysed tokens)`` in one aggregate job. The token
        count bounds the query-term rows; queries x k bounds any result."""
        sizes = queries.select(F.size(self.analyzer.query_tokens("query")).alias("n"))
        row = sizes.agg(F.count(F.lit(1)).alias("q"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
        return int(row["q"]), int(row["t"])

    def _small(self, rows: int) -> bool:
        return rows <= BROADCAST_ROW_LIMIT

    # -- ranked lists without payload ------------------------------------
    def query_terms(self, queries: DataFrame) -> DataFrame:
        """The analysed terms of the queries, written down: they are read more
        than once, and what follows is planned without the analysis."""
        return write_parquet(query_terms(queries, self.analyzer, self.lemmas),
                             scratch_path(queries.sparkSession, "query-terms"))

    def text_ranked(self, queries: DataFrame, k: int, pad: bool = True) -> DataFrame:
        qterms = self.query_terms(queries)
        return text_top_k(self.index, queries, qterms, k, pad=pad,
                          broadcast_terms=self._small(qterms.count())).select(
            "query_id", "rank", "doc_id", "score")

    def text_ranked_pruned(self, queries: DataFrame, k: int, pad: bool = True) -> DataFrame:
        """The rows of ``text_ranked`` with score bounds: fewer postings are
        summed, in more jobs. For corpora where postings are the cost."""
        if self.blocks is None:
            self.blocks = build_blocks(self.index)
        return text_top_k_pruned(self.index, self.blocks, queries, self.query_terms(queries), k,
                                 pad).select(
            "query_id", "rank", "doc_id", "score")

    def vector_ranked(self, query_vectors: DataFrame, k: int,
                      shape: tuple[int, int] | None = None) -> DataFrame:
        return vector_top_k(self.doc_vectors, query_vectors, k, self.max_query_bytes, shape)

    def hybrid_ranked(self, queries: DataFrame, query_vectors: DataFrame, k: int,
                      weights: dict | None = None,
                      depth_factor: int = DEFAULT_DEPTH_FACTOR) -> DataFrame:
        w = check_weights(weights)
        depth = depth_factor * k
        text = self.text_ranked(queries, depth)
        fused = fuse(text, self.vector_ranked(query_vectors, depth), w, self.aliases)
        return fused_top_k(fused, k)

    def query_vectors_for(self, queries: DataFrame) -> DataFrame:
        if self.encoder is None:
            raise ValueError("no query vectors given and no encoder configured")
        from quarry.operators.encoder import encode
        return encode(queries, self.encoder, text_col="query", key="query_id")

    # -- user-level methods (J1-J4) ---------------------------------------
    def text(self, queries: DataFrame, top_k: int = 5, pruned: bool = False) -> DataFrame:
        """J1; with ``pruned`` by score bounds (the same rows)."""
        k = check_top_k(top_k)
        ranked = (self.text_ranked_pruned(queries, k) if pruned
                  else self.text_ranked(queries, k))
        return self._payload(ranked, queries.count() * k, RESULT_COLUMNS)

    def vector(self, query_vectors: DataFrame, top_k: int = 5) -> DataFrame:
        """J2."""
        k = check_top_k(top_k)
        shape = query_shape(query_vectors)
        ranked = self.vector_ranked(query_vectors, k, shape)
        return self._payload(ranked, shape[0] * k, RESULT_COLUMNS)

    def hybrid(self, queries: DataFrame, query_vectors: DataFrame | None = None,
               top_k: int = 5, weights: dict | None = None,
               depth_factor: int = DEFAULT_DEPTH_FACTOR) -> DataFrame:
        """J3."""
        qv = query_vectors if query_vectors is not None else self.query_vectors_for(queries)
        k = check_top_k(top_k)
        ranked = self.hybrid_ranked(queries, qv, k, weights, depth_factor)
        return self._payload(ranked, queries.count() * k, (*RESULT_COLUMNS, "score_type"))

    def search(self, queries: DataFrame, method: str = "hybrid", top_k: int = 5,
               weights: dict | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
        """Method dispatch; an unknown method raises ``ValueError``."""
        check_method(method)
        if method == "text":
            return self.text(queries, top_k)
        qv = query_vectors if query_vectors is not None else self.query_vectors_for(queries)
        if method == "vector":
            return self.vector(qv, top_k)
        return self.hybrid(queries, qv, top_k, weights)

    def ranked(self, method: str, queries: DataFrame, query_vectors: DataFrame, k: int,
               weights: dict | None = None) -> DataFrame:
        """``(query_id, rank, doc_id, score)`` of one method, no payload."""
        check_method(method)
        if method == "text":
            return self.text_ranked(queries, k)
        if method == "vector":
            return self.vector_ranked(query_vectors, k)
        return self.hybrid_ranked(queries, query_vectors, k, weights).select(
            "query_id", "rank", "doc_id", "score")


def nest_results(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Optional nested form: one row per query with its ordered results.

    With ``queries(query_id, ...)``, a query without hits has an empty list.
    """
    item = F.struct("rank", "title", "summary", "url", "date", "score")
    nested = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    if queries is None:
        return nested
    empty = F.array().cast(nested.schema["results"].dataType)
    return queries.select("query_id").join(nested, "query_id", "left").withColumn(
        "results", F.coalesce("results", empty))
