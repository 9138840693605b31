"""Operator 12: vectors compressed to codebook indexes, with norm-of-sum bounds.

A component x becomes the integer floor(scale * x); a vector is cut into parts
(at floor(dimension * i / parts), so equal ones where the number of parts
divides the dimension). Each part position has a codebook of its own, which
begins as that part of the vectors with the smallest ids. A round assigns
every part to its nearest entry (squared Euclidean distance, ties to the lower
index) and replaces each entry by the floor of its parts' mean; an entry
without parts stays. After the rounds the parts are assigned once more.

Bounds. A scan of all entries leaves a lower bound: the distance to the
nearest entry but the assigned one, stamped with its round. All codebooks of
earlier rounds are kept, so in round s the bound of stamp t shrinks by the
length of the *net* displacement of an entry from codebook t to codebook s
(the largest among the other entries), the norm of the sum of its steps. That
is never more, and for entries that turn or come back much less, than the
accumulated drifts, the sum of the steps' norms. The distance to the assigned
entry is always exact. Only a part whose exact distance isn't below its bound
is scanned again; the result is that of scanning everything.

Distances are exact integers. Bounds are rounded down and displacements up, and
a part is skipped only if strictly nearer, so ties are settled by scans.

How it runs. A round is one pass over the rows (``mapInArrow``): vector bytes
and six bytes of state per part in and out, and one row per task with the
task's sums. The pass writes a table in the shared folder, which cuts the
lineage; the driver gets one number per component of the codebooks.

Defined results: rows whose vector is null, or holds a null or non-finite
component, are dropped. Ids order nulls last, equal ids by vector; repeated
rows count each. With fewer rows than entries the codebooks are smaller. An
empty vector has empty parts and error 0. Vectors of different lengths, or so
large that squared distances don't fit into 64 bits, raise ValueError. An
empty table gives an empty table. Other columns stay, and one that has an
output's name is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cleared, columns, dealt, map_batches, python_ready, staged, table
from quarry.session import BROADCAST_ROW_LIMIT

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6

SLACK = 1e-9   # far above the rounding of a square root or a sum of a few

Codebook = list[np.ndarray]   # one (entries, width) array of 64-bit integers per part


@dataclass
class Codebooks:
    """The codebooks of all rounds, and how many parts each pass scanned."""

    cuts: list[int]
    dtype: str
    history: list[Codebook]
    scans: list[int] = field(default_factory=list)

    def digest(self) -> str:
        """SHA-256 of all final components by part, entry and position."""
        numbers = [str(x) for book in self.history[-1] for x in book.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def net_displacements(history: list[Codebook], part: int) -> np.ndarray:
    """[t, a]: the longest way of an entry but ``a`` from codebook t to the last."""
    now = history[-1][part]
    moved = np.stack([np.sqrt(((now - then[part]).astype(np.float64) ** 2).sum(1))
                      for then in history])
    out = np.zeros_like(moved)
    for a in range(moved.shape[1]):
        others = np.delete(moved, a, axis=1)
        if others.shape[1]:
            out[:, a] = others.max(1) * (1 + SLACK)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row, its squared distance, and a lower bound of
    the distance to any other entry."""
    squares = ((x[:, None, :] - book[None]) ** 2).sum(2)
    rows = np.arange(len(x))
    best = squares.argmin(1)      # the first of equals
    least = squares[rows, best]
    if len(book) == 1:
        return best, least, np.full(len(x), np.inf, np.float32)
    squares[rows, best] = np.iinfo(np.int64).max
    other = np.sqrt(squares.min(1).astype(np.float64)) * (1 - SLACK)
    return best, least, np.nextafter(other.astype(np.float32), np.float32(0))


class State:
    """Assigned entries, stamps and bounds of a batch, as bytes of its rows."""

    def __init__(self, data: np.ndarray, parts: int):
        self.data = data
        self.assigned = data[:, :parts]
        self.stamp = data[:, parts:2 * parts]
        self.bound = data[:, 2 * parts:].view("<f4")

    @classmethod
    def new(cls, n: int, parts: int) -> "State":
        return cls(np.zeros((n, 6 * parts), np.uint8), parts)


def assign(x: np.ndarray, model: Codebooks, state: State, first: bool) -> tuple[np.ndarray, int]:
    """Bring ``state`` to the last codebook; squared errors and parts scanned."""
    now, last = len(model.history) - 1, model.history[-1]
    errors, scans = np.zeros(len(x), np.int64), 0
    for p, book in enumerate(last):
        own = x[:, model.cuts[p]:model.cuts[p + 1]]
        if first:
            again = np.arange(len(x))
            exact = np.zeros(len(x), np.int64)
        else:
            a, t = state.assigned[:, p], state.stamp[:, p]
            exact = ((own - book[a]) ** 2).sum(1)
            bound = state.bound[:, p].astype(np.float64) - net_displacements(
                model.history, p)[t, a]
            again = np.flatnonzero(np.sqrt(exact.astype(np.float64)) * (1 + SLACK) >= bound)
        best, least, other = nearest(own[again], book)
        state.assigned[again, p] = best
        state.stamp[again, p] = now
        state.bound[again, p] = other
        exact[again] = least
        errors += exact
        scans += len(again)
    return errors, scans


def sums_of(x: np.ndarray, model: Codebooks, state: State) -> np.ndarray:
    """Per part and entry: component sums, then the number of parts."""
    out = []
    for p, book in enumerate(model.history[-1]):
        chosen = (state.assigned[:, p][None] == np.arange(len(book))[:, None]).astype(np.int64)
        out += [(chosen @ x[:, model.cuts[p]:model.cuts[p + 1]]).ravel(), chosen.sum(1)]
    return np.concatenate(out)


def replaced(model: Codebooks, sums: np.ndarray) -> Codebook:
    """The next codebook; an entry without parts stays."""
    out, at = [], 0
    for book in model.history[-1]:
        total = sums[at:at + book.size].reshape(book.shape)
        n = sums[at + book.size:at + book.size + len(book), None]
        at += book.size + len(book)
        out.append(np.where(n > 0, total // np.maximum(n, 1), book))
    return out


def fixed_binary(data: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as a binary column."""
    rows = np.ascontiguousarray(data)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def from_binary(column: pa.Array, n: int, dtype: str) -> np.ndarray:
    """Inverse of ``fixed_binary`` (a writable copy)."""
    data = b"".join(x.as_buffer().to_pybytes() for x in column) if column.offset else (
        column.buffers()[2].to_pybytes() if column.buffers()[2] else b"")
    values = np.frombuffer(data, dtype).copy()
    return values.reshape(n, len(values) // n)


def integers(column: pa.Array, n: int, dtype: str, scale: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values).astype(dtype).reshape(n, len(values) // n)


def passed(df: DataFrame, model: Codebooks, scale: int, last: bool) -> DataFrame:
    """One pass: rows with the new state and one row of sums per task, or in
    the last pass rows with code and error.

    The last columns of ``df`` are the vector as given (first pass), or as
    bytes, then the state and ``sums``.
    """
    first = len(model.history) == 1
    held = len(df.columns) - (1 if first else 3)
    new = (("code", "string"), ("error", "long")) if last else (
        ("v", "binary"), ("s", "binary"), ("sums", "array<bigint>"))
    schema = df.select(*df.columns[:held],
                       *[F.lit(None).cast(k).alias(c) for c, k in new]).schema
    parts = len(model.cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = [c.type for c in batch.columns[:held]]
            if first:
                x, state = integers(batch.column(held), n, model.dtype, scale), State.new(n, parts)
            else:
                x = from_binary(batch.column(held), n, model.dtype)
                state = State(from_binary(batch.column(held + 1), n, "u1"), parts)
            wide = x.astype(np.int64)
            errors, scans = assign(wide, model, state, first)
            if last:
                codes = state.assigned.tobytes().hex()
                text = [codes[2 * parts * i:2 * parts * (i + 1)] for i in range(n)]
                made = [pa.array(text, pa.string()), pa.array(errors)]
            else:
                own = np.append(sums_of(wide, model, state), scans)
                total = own if total is None else total + own
                made = [fixed_binary(x), fixed_binary(state.data),
                        pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], *made], schema.names)
        if total is not None:
            sums = pa.array([total.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), sums], schema.names)

    return map_batches(df, run, schema)


def finite(vector: str) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True))


def prepared(df: DataFrame, vec_id: str, vector: str, parts: int, entries: int,
             scale: int) -> Codebooks | None:
    """The first codebook of ``df`` (kept rows only); None if there are none."""
    size = F.size(vector)
    most = F.aggregate(vector, F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c.cast("double"))))
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"),
                   F.max(size).alias("high"), F.max(most).alias("most")).first()
    if not shape["n"]:
        return None
    if shape["low"] != shape["high"]:
        raise ValueError(f"vectors of {shape['low']} and {shape['high']} components")
    d, bound = shape["high"], int(scale * shape["most"]) + 1
    if 4 * max(d, 1) * bound * bound >= 1 << 63 or bound * shape["n"] >= 1 << 62:
        raise ValueError(f"components up to {shape['most']} are too large")
    order = (F.col(vec_id).asc_nulls_last(), F.col(vector).asc())
    seeds = df.select(vec_id, vector).orderBy(*order).limit(entries).collect()   # <= entries
    start = np.floor(scale * np.array([r[1] for r in seeds], np.float64).reshape(
        len(seeds), d)).astype(np.int64)
    cuts = [d * i // parts for i in range(parts + 1)]
    dtype = next(t for t in ("<i2", "<i4", "<i8") if bound < np.iinfo(t).max)
    return Codebooks(cuts, dtype, [[start[:, a:b] for a, b in zip(cuts, cuts[1:])]])


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """Kept rows with ``code`` (two hex digits a part) and ``error`` in place of
    the vector, and the codebooks (None for no rows)."""
    if not 0 < entries <= 256 or not 0 <= rounds < 255:
        raise ValueError("codes have one byte a part, stamps one byte")
    python_ready(df.sparkSession)
    df = cleared(df, ["code", "error"], [vec_id, vector])
    others = [c for c in df.columns if c != vector]
    names = [f"c{i}" for i in range(len(others))]
    at = {c: x for c, x in zip(df.columns, columns(df), strict=True)}
    rows = df.select(*[at[c].alias(n) for c, n in zip(others, names, strict=True)],
                     at[vector].alias("vector"))
    rows = rows.where(finite("vector"))
    model = prepared(rows, names[others.index(vec_id)], "vector", parts, entries, scale)
    if model is None:
        return rows.drop("vector").toDF(*others).select(
            "*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    for _ in range(rounds):
        rows = staged(passed(rows, model, scale, last=False), "codes")
        sums = rows.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x"))
        found = sums.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
        *total, scans = [r["x"] for r in found]   # one number per codebook component
        model.scans.append(scans)
        model.history.append(replaced(model, np.array(total, np.int64)))
        rows = rows.where("sums IS NULL")
    coded = passed(rows, model, scale, last=True)
    return coded.toDF(*others, "code", "error"), model


def with_label_error(rows: DataFrame, label: str = "label", error: str = "error",
                     limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """``rows`` (written rows) with ``label_error``, the error summed over equal
    labels, nulls together.

    Up to ``limit`` labels come back by broadcast. Of more, those that hold over
    a thousandth of the rows (a thousand at most) do, and the others, none of
    them frequent, by a shuffled join.
    """
    sums = staged(rows.groupBy(F.col(label).alias("_label")).agg(
        F.sum(error).alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    same = F.col(label).eqNullSafe(F.col("_label"))
    labels, total = sums.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if labels <= limit:
        return rows.join(F.broadcast(sums), same).drop("_label", "_n")
    hot = F.col("_n") * 1000 > total
    frequent = F.broadcast(sums.where(hot))
    near = rows.join(frequent, same).drop("_label", "_n")
    rest = rows.join(frequent, same, "left_anti").join(sums.where(~hot), same).drop("_label", "_n")
    return near.unionByName(rest)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's code and error, and the final codebooks' digest."""
    vectors = dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded, model = compress(vectors)
    rows = staged(coded, "vector-codes")
    digest = model.digest() if model else hashlib.sha256(b"").hexdigest()
    return with_label_error(rows).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql_rounds() -> str:
    """Chained tables: codebook c0, assignment a0, codebook c1, ..."""
    found = []
    for r in range(ROUNDS + 1):
        found.append(f"""a{r} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, e := e)) AS m
  FROM (SELECT r, p.part, e, coalesce(list_sum(list_transform(list_zip(x, c),
    lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS d FROM p JOIN c{r} USING (part))
  GROUP BY r, part)""")
        if r < ROUNDS:
            found.append(f"""s{r} AS (SELECT part, e, i, sum(x) AS s, count(*) AS n
  FROM (SELECT part, m.e AS e, unnest(x) AS x, unnest(generate_series(1, len(x))) AS i
        FROM a{r} JOIN p USING (r, part)) GROUP BY part, e, i),
l{r} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM s{r} GROUP BY part, e),
c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(l{r}.c, c{r}.c) AS c
  FROM c{r} LEFT JOIN l{r} USING (part, e))""")
    return ",\n".join(found)


OP12_SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part,
  v[(len(v) * part) // {PARTS} + 1 : (len(v) * (part + 1)) // {PARTS}] AS x
  FROM k, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= {ENTRIES}),
{_sql_rounds()},
f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code,
  CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
g AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h
  FROM c{ROUNDS}),
t AS (SELECT k.vec_id, k.label, code, error FROM f JOIN k USING (r)),
u AS (SELECT label, sum(error) AS label_error FROM t GROUP BY label)
SELECT vec_id, code, error, CAST(label_error AS BIGINT) AS label_error, h AS codebooks_sha256
FROM t JOIN u ON t.label IS NOT DISTINCT FROM u.label, g
"""
