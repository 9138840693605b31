"""Operator 1: BPE encoding and decoding by per-prefix dynamic programming.

``encode`` turns whole texts into the ids of a word-level BPE vocabulary,
``decode`` turns ids back into text; both are one pass over the rows, with no
shuffle. See ``wordbpe`` for the method.

Defined results: null or empty text gives no ids and the empty text; any
length of text or word works (long words are not memoised); repeated rows are
encoded alike; an empty table gives an empty table; other columns stay, and
one that has an output's name is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cleared, documents, map_batches, python_ready, whole_text
from quarry.llm.wordbpe import WordBpe

_LOADED: dict[bytes, WordBpe] = {}


def load(data: bytes) -> WordBpe:
    """The coder of a vocabulary file, built once per Python worker."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(data)
    return _LOADED[key]


def share(spark: SparkSession, vocab_path: str) -> Broadcast:
    """The vocabulary file's bytes (a few MB, whatever the corpus)."""
    with open(vocab_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def id_lists(blocks: list[bytes]) -> pa.ListArray:
    """Little-endian four-byte ids of each row as one Arrow list column."""
    ends = np.cumsum([0] + [len(b) // 4 for b in blocks], dtype=np.int64)
    values = np.frombuffer(b"".join(blocks), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def encode(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text``; with ``decoded``, also what they decode to."""
    spark = df.sparkSession
    df = cleared(df, [ids, *([decoded] if decoded else [])], [text])
    python_ready(spark)
    vocab = share(spark, vocab_path)
    schema = df.select("*", F.lit(None).cast("array<int>").alias(ids)).schema
    if decoded:
        schema = schema.add(decoded, "string")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocab.value)
        for batch in batches:
            blocks = [coder.encode(t or "") for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, id_lists(blocks)]
            names = [*batch.schema.names, ids]
            if decoded:
                texts = [coder.decode(np.frombuffer(b, "<i4").tolist()) for b in blocks]
                columns.append(pa.array(texts, pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(df, run, schema)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids`` decode to (null ids: empty text)."""
    spark = df.sparkSession
    df = cleared(df, [text], [ids])
    python_ready(spark)
    vocab = share(spark, vocab_path)
    schema = df.select("*", F.lit("").alias(text)).schema
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocab.value)
        for batch in batches:
            texts = [coder.decode(row or []) for row in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return map_batches(df, run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", whole_text().alias("text"))
    both = encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
