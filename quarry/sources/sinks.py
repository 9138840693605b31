"""Sinks (A4, A5, A6, A9). All are plain DataFrame writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(corpus: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A4: the prepared corpus, as Parquet (default) or JSON lines."""
    corpus.write.mode("overwrite").format(fmt).save(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """A5: ``(doc_id, embedding)`` as Parquet."""
    vectors.write.mode("overwrite").parquet(path)


def id_mapping(docs: DataFrame) -> DataFrame:
    """``(url, idx)`` where ``idx`` is the document position (``doc_ord``);
    a URL given twice keeps its last position. ``docs`` has url, doc_ord."""
    return docs.groupBy("url").agg(F.max("doc_ord").alias("idx"))


def write_id_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Evaluation results, one sub-directory per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")
