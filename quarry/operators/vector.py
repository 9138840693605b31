"""Exact inner-product search over a whole query table.

The work is all pairs (query, document), as with a flat inner-product index,
but pairs are never rows: each task multiplies its document block by the
query matrix (numpy, float64) and keeps a running top-k per query, exact
under the final order (score key desc, doc_id asc). Only ``k`` rows per
query per task leave the task; a last ``row_number`` window picks the global
top-k.

* Broadcast path: the query matrix is shipped once when
  ``rows x dim x 8`` bytes is within ``max_query_bytes`` (checked by count).
* Block path, beyond that bound: queries are cut into ``nq`` hash blocks and
  documents into ``nd`` hash chunks; every document row is replicated once
  per query block and every query row once per document chunk, and each
  (query block, document chunk) group is scored by ``applyInPandas``. Group
  size is bounded by construction (hash of unique ids), so there is no hot
  group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import RANK_SCALE, rank_key
from quarry.session import ship_package

MAX_QUERY_BYTES = 256 << 20
# Bound on the score matrix materialised at once inside a task (cells).
MAX_BLOCK_CELLS = 4_000_000

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def _keys(scores: np.ndarray) -> np.ndarray:
    # Same IEEE operations as quarry.functions.text.rank_key.
    return np.floor(scores * RANK_SCALE + 0.5)


def _select_top(qcol, keys, doc_ids, scores, k):
    """Keep per query column the first k rows by (key desc, doc_id asc)."""
    if len(qcol) == 0:
        return qcol, keys, doc_ids, scores
    order = np.lexsort((doc_ids, -keys, qcol))
    qcol, keys, doc_ids, scores = qcol[order], keys[order], doc_ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, qcol[1:] != qcol[:-1]])
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(qcol)]))
    keep = (np.arange(len(qcol)) - group_start) < k
    return qcol[keep], keys[keep], doc_ids[keep], scores[keep]


class TopK:
    """Running exact top-k per query over document blocks."""

    def __init__(self, qmat: np.ndarray, k: int):
        self.qmat = qmat
        self.k = k
        empty_i = np.empty(0, dtype=np.int64)
        empty_f = np.empty(0, dtype=np.float64)
        self.state = (empty_i, empty_f, empty_i, empty_f)

    def add(self, doc_ids: np.ndarray, docs: np.ndarray) -> None:
        n, nq = len(doc_ids), self.qmat.shape[0]
        if n == 0 or nq == 0:
            return
        step = max(1, MAX_BLOCK_CELLS // n)
        parts = [self.state]
        for q0 in range(0, nq, step):
            s = docs @ self.qmat[q0:q0 + step].T          # (n, q)
            keys = _keys(s)
            if n > self.k:
                thr = np.partition(keys, n - self.k, axis=0)[n - self.k]
                rows, cols = np.nonzero(keys >= thr)
            else:
                rows, cols = np.nonzero(np.ones_like(keys, dtype=bool))
            parts.append((cols.astype(np.int64) + q0, keys[rows, cols], doc_ids[rows],
                          s[rows, cols]))
            merged = tuple(np.concatenate([p[i] for p in parts]) for i in range(4))
            parts = [_select_top(*merged, self.k)]
        self.state = parts[0]


def _checked(mat: np.ndarray) -> np.ndarray:
    if not np.isfinite(mat).all():
        raise ValueError("a vector has a component that is null, NaN or infinite")
    return mat


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    sizes = np.asarray(pc.list_value_length(lists))
    if (sizes != dim).any():
        raise ValueError(f"a vector has {sizes[sizes != dim][0]} components, expected {dim}")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _checked(flat.reshape(-1, dim))


def _broadcast_scorer(bq, k: int, dim: int):
    def run(batches):
        qids, qmat = bq.value
        top = TopK(qmat, k)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            top.add(rb.column(0).to_numpy(zero_copy_only=False).astype(np.int64),
                    _matrix(rb.column(1), dim))
        qcol, _, doc_ids, scores = top.state
        if len(qcol):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[qcol], pa.int64()), pa.array(doc_ids, pa.int64()),
                 pa.array(scores, pa.float64())],
                schema=pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()),
                                  ("score", pa.float64())]))
    return run


def _group_scorer(k: int, dim: int):
    import pandas as pd

    def run(pdf: "pd.DataFrame") -> "pd.DataFrame":
        q = pdf[pdf["side"] == 0]
        d = pdf[pdf["side"] == 1]
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        qids = q["id"].to_numpy(np.int64)
        top = TopK(_matrix(pa.array(q["vec"], pa.list_(pa.float64())), dim), k)
        top.add(d["id"].to_numpy(np.int64),
                _matrix(pa.array(d["vec"], pa.list_(pa.float64())), dim))
        qcol, _, doc_ids, scores = top.state
        return pd.DataFrame({"query_id": qids[qcol], "doc_id": doc_ids, "score": scores})
    return run


def query_shape(vectors: DataFrame, col: str = "embedding") -> tuple[int, int]:
    """``(rows with a vector, dimension)`` in one aggregate job; vectors of
    different lengths raise ``ValueError``."""
    row = vectors.where(F.size(col) > 0).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size(col)).alias("least"),
        F.max(F.size(col)).alias("d")).first()
    if row["least"] != row["d"]:
        raise ValueError(f"query vectors have {row['least']} to {row['d']} components")
    return int(row["n"]), int(row["d"] or 0)


def document_dimension(vectors: DataFrame, col: str = "embedding") -> int:
    """The length of the first document vector; tasks check all the others."""
    row = vectors.where(F.size(col) > 0).select(F.size(col).alias("d")).first()
    return int(row["d"]) if row else 0


def vector_hits(doc_vecs: DataFrame, query_vecs: DataFrame, k: int,
                max_query_bytes: int = MAX_QUERY_BYTES,
                shape: tuple[int, int] | None = None) -> DataFrame:
    """Per-task top-k candidates ``(query_id, doc_id, score)``.

    ``doc_vecs(doc_id, embedding)`` and ``query_vecs(query_id, embedding)``.
    The document vectors set the dimension. Rows without a vector (null or
    empty) are ignored; a vector of another length, or with a component that
    isn't finite, raises ``ValueError``.
    """
    spark = doc_vecs.sparkSession
    ship_package(spark)
    n_queries, query_dim = shape or query_shape(query_vecs)
    dim = document_dimension(doc_vecs)
    if dim == 0 or n_queries == 0:
        return spark.createDataFrame([], HIT_SCHEMA)
    if query_dim != dim:
        raise ValueError(f"query vectors have {query_dim} components, documents {dim}")
    docs = doc_vecs.where(F.size("embedding") > 0).select(
        F.col("doc_id").cast("long"), "embedding")
    queries = query_vecs.where(F.size("embedding") > 0).select(
        F.col("query_id").cast("long"), "embedding")
    if n_queries * dim * 8 <= max_query_bytes:
        table = queries.toArrow()
        qids = table.column("query_id").to_numpy().astype(np.int64)
        qmat = _matrix(table.column("embedding").combine_chunks(), dim) if n_queries else \
            np.empty((0, dim))
        bq = spark.sparkContext.broadcast((qids, qmat))
        return docs.mapInArrow(_broadcast_scorer(bq, k, dim), HIT_SCHEMA)

    # Block sizes by memory: a query block and a document chunk each hold at
    # most max_query_bytes of vectors (TopK bounds the score matrix itself).
    # Rows shuffled: documents x nq + queries x nd, the block-matrix product.
    n_docs = docs.count()
    nq = max(1, math.ceil(n_queries * dim * 8 / max_query_bytes))
    nd = max(1, math.ceil(n_docs * dim * 8 / max_query_bytes))
    q_rep = queries.select(
        F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("embedding").alias("vec"),
        F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qblock"),
        F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("dchunk"))
    d_rep = docs.select(
        F.lit(1).alias("side"), F.col("doc_id").alias("id"), F.col("embedding").alias("vec"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qblock"),
        F.pmod(F.xxhash64("doc_id"), F.lit(nd)).cast("int").alias("dchunk"))
    both = q_rep.unionByName(d_rep)
    return both.groupBy("qblock", "dchunk").applyInPandas(_group_scorer(k, dim), HIT_SCHEMA)


def vector_top_k(doc_vecs: DataFrame, query_vecs: DataFrame, k: int,
                 max_query_bytes: int = MAX_QUERY_BYTES,
                 shape: tuple[int, int] | None = None) -> DataFrame:
    """J2 core: ``(query_id, rank, doc_id, score)``, raw inner products."""
    hits = vector_hits(doc_vecs, query_vecs, k, max_query_bytes, shape)
    w = Window.partitionBy("query_id").orderBy(F.col("_key").desc(), F.col("doc_id").asc())
    return (hits.withColumn("_key", rank_key("score"))
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(k))
            .select("query_id", "rank", "doc_id", "score"))


def document_vectors(embeddings: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, embedding)`` for vectors that have a document (left semi
    join on the key, before any ranking). ``embeddings`` has ``doc_id``."""
    keys = docs.select(F.col(key).alias("doc_id"))
    return embeddings.select("doc_id", "embedding").join(keys, "doc_id", "left_semi")
