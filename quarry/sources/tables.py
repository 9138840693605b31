"""Parquet tables of a data directory, mapped onto the search data model.

Mapping (fixed, shared with the SQL oracle):

* key ``doc_id``; ``url = 'doc://' || source || '/' || doc_id``;
* title = first line of ``text``; summary = the first line after it that isn't
  blank, whole (the title again where there is none); text = ``text``;
  date = ``'1970-01-01'`` (an opaque string); lang = ``lang``;
* document vectors: ``embeddings.vec_id = doc_id``, kept only when the
  document exists;
* queries: ``benchmark(item_id, text)``; query vector: the embedding whose
  ``vec_id = item_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
URL_PREFIX = "doc://"
FIXED_DATE = "1970-01-01"
# --- end of fixed values ----------------------------------------------------


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """A3 and the other scans: one Parquet table of ``data_dir``."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def raw_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(doc_id, url, date, title, summary, text, lang)`` from ``documents``."""
    d = table(spark, data_dir, "documents")
    lines = F.split("text", "\n")
    after = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "")
    return d.select(
        "doc_id",
        F.concat(F.lit(URL_PREFIX), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("url"),
        F.lit(FIXED_DATE).alias("date"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.coalesce(F.get(after, F.lit(0)), F.get(lines, F.lit(0))).alias("summary"),
        F.col("text"), F.col("lang"),
    )


def benchmark_queries(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(query_id, query, description)`` from ``benchmark``."""
    b = table(spark, data_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"),
                    F.lit("").alias("description"))


def embeddings(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(doc_id, embedding)`` from ``embeddings``."""
    e = table(spark, data_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding")


def benchmark_query_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    """``(query_id, embedding)``: stand-in for the query encoder."""
    b = table(spark, data_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    e = table(spark, data_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding")
    return e.join(b, "query_id", "left_semi")
