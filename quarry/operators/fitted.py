"""An encoder fitted to the corpus (C1, C2): latent semantic vectors by a
randomised singular value decomposition of the document-term matrix.

A document's row has ``log(1 + tf) * idf`` for each of its terms, scaled to
unit length. Terms (of any letters) are hashed to ``columns`` columns with a
sign, so the matrix has a width set by a parameter, not by the vocabulary.

Texts are cut, counted and hashed once; their rows are written as columns and
weights, which every round reads.

Fitting (Halko, Martinsson and Tropp 2011): the range of A'A is found from a
random block Q of ``rank + extra`` columns by ``passes`` rounds of A'(A Q),
each one pass over the documents (``mapInArrow``): a task keeps one
columns x (rank + extra) array, whatever its number of documents, and sums of
the tasks' arrays are taken by ranges of columns in Spark. The driver gets one
array of that size a round, for a QR; a last pass yields the small square
matrix whose eigenvectors turn Q into the leading right singular vectors.

Encoding multiplies a text's row by those vectors and scales it to unit
length. ``FittedEncoder`` is an encoder factory like any other, so documents
and queries go through :func:`quarry.operators.encoder.encode`.

Defined results: null and empty texts, and those without terms, give zero
vectors; an empty corpus gives an encoder that gives zero vectors.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN_PATTERN
from quarry.session import scratch_path, ship_package, write_parquet

RANK, EXTRA, COLUMNS, PASSES = 64, 16, 1 << 14, 4
SEED = 7
CHUNK = 1 << 10   # columns summed by one task
ROWS = 256        # documents unpacked at a time
# The tokens with a letter or digit; punctuation is never part of one.
WORD_PATTERN = TOKEN_PATTERN.split(r"|\.\.\.")[0]


def hashed(term: str, columns: int) -> tuple[int, float]:
    """Column and sign of a term."""
    h = int.from_bytes(hashlib.blake2b(term.encode("utf-8"), digest_size=8).digest(), "little")
    return h % columns, 1.0 if h >> 63 else -1.0


class Rows:
    """Lists of terms as a sparse unit-length matrix."""

    def __init__(self, idf: np.ndarray | None, columns: int):
        self.idf, self.columns, self.known = idf, columns, {}

    def column(self, term: str) -> tuple[int, float]:
        if len(self.known) > 200_000:
            self.known.clear()
        found = self.known.get(term)
        if found is None:
            found = self.known[term] = hashed(term, self.columns)
        return found

    def weights(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and signed weights of one document, without IDF and norm."""
        counts = Counter(terms)
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        at, sign = zip(*map(self.column, counts), strict=True)
        value = np.array(sign) * np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        # Terms in one column are added, as the hashed matrix has them.
        columns, inverse = np.unique(np.array(at), return_inverse=True)
        return columns, np.bincount(inverse, weights=value, minlength=len(columns))

    def row(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of one document; several terms may share a column."""
        columns, value = self.weights(terms)
        if self.idf is not None:
            value = value * self.idf[columns]
        norm = np.sqrt((value ** 2).sum())
        return columns, value / norm if norm > 0 else value

    def times(self, lists: list[list[str]], block: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lists), block.shape[1]))
        for i, terms in enumerate(lists):
            at, value = self.row(terms)
            out[i] = value @ block[at]
        return out


def weighted(docs: DataFrame, columns: int) -> DataFrame:
    """``(at, weight)``: the rows of ``docs(terms)``, hashed and counted once for
    all rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Rows(None, columns)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                found = [plain.weights(t) for t in batch.column(0).slice(a, ROWS).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(c) for c, _ in found)]), pa.int32())
                flat = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(flat[1], pa.float64()))],
                    ["at", "weight"])

    ship_package(docs.sparkSession)
    return docs.select("terms").mapInArrow(run, "at array<int>, weight array<double>")


def flat_rows(batch: pa.RecordBatch, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and weights of ``ROWS`` documents from ``a`` in one array each, and
    where the documents that have any begin."""
    at, weight = (batch.column(i).slice(a, ROWS) for i in (0, 1))
    sizes = np.asarray(pc.list_value_length(at), np.int64)
    return (at.flatten().to_numpy().astype(np.int64), weight.flatten().to_numpy(),
            (np.cumsum(sizes) - sizes)[sizes > 0])


def summed(rows: DataFrame, make, width: int, columns: int) -> np.ndarray:
    """Sum over all documents of what ``make(at, weight, starts, total)`` adds to
    a (columns, width) array, by tasks, then by ranges of columns."""
    spark = rows.sparkSession
    schema = "chunk int, part binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, width))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                at, weight, starts = flat_rows(batch, a)
                if len(at):
                    make(at, weight, starts, total)
        chunks = [(c, total[a:a + CHUNK].tobytes())
                  for c, a in enumerate(range(0, columns, CHUNK)) if total[a:a + CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in chunks], pa.int32()),
             pa.array([p for _, p in chunks], pa.binary())], ["chunk", "part"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(p.as_buffer(), np.float64)
                held[c] = held[c] + own if c in held else own.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()),
             pa.array([v.tobytes() for v in held.values()], pa.binary())], ["chunk", "part"])

    ship_package(spark)
    n_chunks = -(-columns // CHUNK)
    parts = rows.select("at", "weight").mapInArrow(partial, schema)
    sums = parts.repartition(min(n_chunks, 64), "chunk").mapInArrow(reduce, schema)
    out = np.zeros((columns, width))
    for r in sums.toLocalIterator():   # one array in all, chunk by chunk
        a = r["chunk"] * CHUNK
        out[a:a + CHUNK] = np.frombuffer(r["part"], np.float64).reshape(-1, width)
    return out


@dataclass
class FittedEncoder:
    """Encoder factory: texts to unit-length latent vectors."""

    idf: np.ndarray | None      # by column
    vectors: np.ndarray         # (columns, rank)
    values: np.ndarray          # singular values, largest first

    @property
    def cache_key(self) -> str:
        return hashlib.sha256(self.vectors.tobytes()).hexdigest()

    def __call__(self):
        import regex

        pattern = regex.compile(WORD_PATTERN)
        rows = Rows(self.idf, len(self.vectors))

        def run(texts: list[str]) -> np.ndarray:
            return rows.times([pattern.findall(t.lower()) for t in texts], self.vectors)

        return run


def words(tokens: list[str]) -> list[str]:
    """Tokens with a letter or digit."""
    return [t for t in tokens if t[0].isalnum() or t[0] == "_"]


def fit_encoder(df: DataFrame, text: str = "text", rank: int = RANK, extra: int = EXTRA,
                columns: int = COLUMNS, passes: int = PASSES) -> FittedEncoder:
    """Fit on every row of ``df``."""
    spark = df.sparkSession
    listed = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))),
                                  F.lit(WORD_PATTERN), 0)
    docs = write_parquet(weighted(df.select(listed.alias("terms")), columns),
                         scratch_path(spark, "rows"))
    width = rank + extra

    def count(at: np.ndarray, weight: np.ndarray, starts: np.ndarray, total: np.ndarray) -> None:
        total[:, 0] += np.bincount(at, minlength=columns)

    df_by_column = summed(docs, count, 1, columns)[:, 0]
    n = docs.count()
    if not n:
        return FittedEncoder(None, np.zeros((columns, rank)), np.zeros(rank))
    idf = np.log((1 + n) / (1 + df_by_column)) + 1

    def gram(block: np.ndarray):
        shared = spark.sparkContext.broadcast(block)   # columns x (rank + extra) numbers

        def add(at: np.ndarray, weight: np.ndarray, starts: np.ndarray, total: np.ndarray) -> None:
            value = weight * idf[at]
            norm = np.sqrt(np.add.reduceat(value ** 2, starts))
            ends = np.append(starts[1:], len(at))
            for a, b, length in zip(starts.tolist(), ends.tolist(), norm.tolist(), strict=True):
                if length > 0:
                    own, v = at[a:b], value[a:b] / length
                    total[own] += np.outer(v, v @ shared.value[own])

        return summed(docs, add, block.shape[1], columns)

    block = np.random.default_rng(SEED).standard_normal((columns, width))
    for _ in range(passes):
        block, _ = np.linalg.qr(gram(np.linalg.qr(block)[0]))
    small = block.T @ gram(block)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    return FittedEncoder(idf, block @ turn[:, order], np.sqrt(np.maximum(values[order], 0)))
