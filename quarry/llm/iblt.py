"""Operator 2: document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs are its lines, cut after sentence ends and every 256
characters; each gets a 64-bit digest (the k-th copy of a paragraph has seed
k, so a text is a set of digests). A sketch of m cells holds, for the digests
dealt to a cell, their count, their XOR and the XOR of their check sums; a
digest goes to one cell of each third. Subtracting two versions' sketches
cancels what they share; peeling cells of a single digest recovers the
digests they differ in. If peeling stalls, both texts are sketched again in
twice the cells. Likeness is shared / all digests.

The fingerprint is the sketch of ``CELLS`` cells with the number of digests.

``next`` of a document is the one with the next id. Documents are dealt out by
id ranges whose bounds are ids of the table; the document at a bound also goes
to the range before it as a guest, and the first one to the last range. So
each task sees its neighbours, and texts move once. Bounds are as many as the
ranges (one per 32 MB of text).

Defined results: null or empty text has no paragraphs; two texts without
paragraphs have likeness 1; rows of equal id follow each other in order of
their text; a null id comes first; a single document is its own next; an
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, python_ready, whole_text

CELLS = 12               # of the fingerprint, and of the first try
RANGE_BYTES = 32 << 20   # text bytes of a task
PIECE = re.compile(r"[^\n]{1,256}?(?:[.!?](?= )|(?=\n)|\Z)|[^\n]{256}")
DOUBLINGS = 16
NO_ID = -(1 << 63)
MULTIPLIERS = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(" ") for x in PIECE.findall(text)) if p]


def digests(text: str) -> np.ndarray:
    """One 64-bit digest per paragraph and copy."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append(xxhash.xxh64_intdigest(p, k))
    return np.array(out, dtype=np.uint64)


def scrambled(d: np.ndarray, which: int) -> np.ndarray:
    d = (d ^ d >> np.uint64(32)) * MULTIPLIERS[which]
    return d ^ d >> np.uint64(29)


def check_sum(d: np.ndarray) -> np.ndarray:
    return scrambled(scrambled(d, 3), 0) >> np.uint64(32)


class Sketches:
    """Sketches of many texts, of equal size."""

    def __init__(self, rows: int, cells: int):
        self.third = cells // 3
        self.cells = 3 * self.third
        self.count = np.zeros(rows * self.cells, np.int64)
        self.keys = np.zeros(rows * self.cells, np.uint64)
        self.checks = np.zeros(rows * self.cells, np.uint64)

    def add(self, rows: np.ndarray, d: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = check_sum(d)
        for j in range(3):
            spot = (scrambled(d, j) >> np.uint64(8)) % np.uint64(self.third)
            at = rows * self.cells + j * self.third + spot.astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, d)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Sketches) -> None:
        self.count -= other.count
        self.keys ^= other.keys
        self.checks ^= other.checks

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (rows, digests, signs); emptied cells show success."""
        found = []
        for _ in range(4 * self.cells):   # each round but a clash of check sums finds a digest
            at = np.nonzero(np.abs(self.count) == 1)[0]
            at = at[check_sum(self.keys[at]) == self.checks[at]]
            if not len(at):
                break
            rows, d, sign = at // self.cells, self.keys[at], self.count[at]
            order = np.lexsort((d, rows))
            rows, d, sign = rows[order], d[order], sign[order]
            once = np.concatenate([[True], (np.diff(rows) != 0) | (d[1:] != d[:-1])])
            found.append((rows[once], d[once], sign[once]))
            self.add(rows[once], d[once], -sign[once])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def empty_rows(self) -> np.ndarray:
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return ~left.reshape(-1, self.cells).any(axis=1)

    def text(self, row: int, n: int) -> str:
        own = slice(row * self.cells, (row + 1) * self.cells)
        raw = (np.uint32(n).tobytes() + self.count[own].astype("<u4").tobytes()
               + self.keys[own].astype("<u8").tobytes()
               + self.checks[own].astype("<u4").tobytes())
        return base64.b85encode(raw).decode("ascii")


def sketched(texts: list[np.ndarray], cells: int) -> Sketches:
    out = Sketches(len(texts), cells)
    if texts:
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        out.add(rows, np.concatenate(texts))
    return out


def fingerprints(texts: list[np.ndarray], cells: int = CELLS) -> list[str]:
    sketches = sketched(texts, cells)
    return [sketches.text(i, len(t)) for i, t in enumerate(texts)]


def differences(a: list[np.ndarray], b: list[np.ndarray],
                cells: int = CELLS) -> list[tuple[set, set]]:
    """(digests of a alone, digests of b alone) of each pair of versions."""
    out: list[tuple[set, set]] = [(set(), set()) for _ in a]
    open_pairs = np.arange(len(a))
    for _ in range(DOUBLINGS):
        if not len(open_pairs):
            return out
        difference = sketched([a[i] for i in open_pairs], cells)
        difference.minus(sketched([b[i] for i in open_pairs], cells))
        rows, d, sign = difference.peel()
        done = difference.empty_rows()
        for r, x, s in zip(rows.tolist(), d.tolist(), sign.tolist(), strict=True):
            if done[r]:
                out[open_pairs[r]][s < 0].add(x)
        open_pairs = open_pairs[~done]
        cells *= 2
    for i in open_pairs:   # a clash of digests that no size resolves
        x, y = set(a[i].tolist()), set(b[i].tolist())
        out[i] = (x - y, y - x)
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differences(a, b), strict=True):
        apart = len(only_x) + len(only_y)
        every = len(x) + len(y) + apart
        out.append((len(x) + len(y) - apart) / every if every else 1.0)
    return out


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def beside_next(df: DataFrame, doc_id: str, text: str, range_bytes: int) -> DataFrame:
    """(guest, doc_id, text) in partitions of consecutive ids and one guest.

    Sorted within partitions; what follows a partition's last own row is its
    first guest.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    key = F.coalesce("doc_id", F.lit(NO_ID))
    total, least = rows.agg(F.sum(F.octet_length("text")), F.min(key)).first()
    ranges = max(1, math.ceil((total or 0) / range_bytes))
    bounds: list[int] = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        found = rows.select(key.alias("key")).agg(F.percentile_approx("key", at, 10_000)).first()[0]
        bounds = sorted({x for x in found if x > least})
    last = len(bounds)
    python_ready(df.sparkSession)
    cuts = np.array(bounds, np.int64)

    @F.arrow_udf("array<struct<part:int,guest:int>>")
    def parts(ids: pa.Array) -> pa.Array:
        ids = np.asarray(ids)
        own = np.searchsorted(cuts, ids, side="right")
        out = []
        for i, p in zip(ids.tolist(), own.tolist(), strict=True):
            places = [(p, 0)]
            if p and cuts[p - 1] == i:
                places.append((p - 1, 1))
            if i == least:
                places.append((last, 1))
            out.append([{"part": x, "guest": g} for x, g in places])
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("guest", pa.int32())])))

    dealt = rows.withColumn("at", F.explode(parts(key))).select("at.*", "doc_id", "text")
    return (dealt.repartitionById(last + 1, F.col("part")).drop("part")
            .sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "text"))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double, "
          "n_paragraphs long")


def compare_versions(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text and its edited version, and their likeness."""
    def block(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        own = [digests(t) for t in texts]
        new = [digests(t) for t in changed]
        after = [*own[1:], digests(following[-1])]
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed]),
            pa.array(fingerprints(own)), pa.array(fingerprints(new)),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
            pa.array([len(d) for d in own], pa.int64())],
            [f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ended = False
        for batch in batches:
            for guest, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ended:
                    continue
                if held and (guest or len(held) >= 500):
                    yield block(held, [x for _, x in held[1:]] + [t])
                    held = []
                ended = bool(guest)
                if not guest:
                    held.append((i, t))

    return beside_next(df, doc_id, text, range_bytes).mapInArrow(run, SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return compare_versions(documents(spark, sf_dir).select("doc_id", "text"))
