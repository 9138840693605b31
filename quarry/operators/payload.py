"""Late materialisation of result rows.

Scoring runs on narrow tables (ids and numbers). Only the final top-k rows,
whose count is at most ``queries x k``, are joined to the document payload, a
narrow copy of the corpus (key, title, summary, url, date). It is partitioned
on disk by a hash bucket of the key and sorted by key, and the join is on
(bucket, key): dynamic partition pruning then skips at run time the buckets
that hold none of the results, for result sets of every size. The result side
is broadcast where the caller has checked its size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import write_parquet

PAYLOAD_COLUMNS = ("title", "summary", "url", "date")
ROWS_PER_BUCKET = 250_000
BUCKET = "pbucket"


def key_bucket(n_buckets: int):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_buckets)).cast("int")


def build_payload(corpus: DataFrame, path: str, key: str = "doc_id",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The narrow payload table, partitioned by key bucket, sorted by key.

    The bucket count rides along as a column, so that a reader needs nothing
    but the table.
    """
    n_buckets = max(1, math.ceil(corpus.count() / rows_per_bucket))
    narrow = corpus.select(F.col(key).alias("doc_id"), *PAYLOAD_COLUMNS)
    narrow = narrow.withColumn(BUCKET, key_bucket(n_buckets))
    written = write_parquet(narrow.repartition(n_buckets, BUCKET).sortWithinPartitions("doc_id"),
                            f"{path}/buckets={n_buckets}", partition_by=[BUCKET])
    return written


def bucket_count(payload_table: DataFrame) -> int | None:
    """The bucket count of a table of ``build_payload``, from its path."""
    if BUCKET not in payload_table.columns:
        return None
    for file in payload_table.inputFiles()[:1]:
        return int(file.split("/buckets=")[1].split("/")[0])
    return 1


def with_payload(results: DataFrame, payload_table: DataFrame, key: str = "doc_id",
                 small_results: bool = True, n_buckets: int | None = None) -> DataFrame:
    """Attach ``title, summary, url, date`` to result rows keyed by ``doc_id``."""
    on = ["doc_id"]
    payload = payload_table.select(F.col(key).alias("doc_id"), *PAYLOAD_COLUMNS,
                                   *([BUCKET] if n_buckets else []))
    if n_buckets:
        on = [BUCKET, "doc_id"]
        results = results.withColumn(BUCKET, key_bucket(n_buckets))
    side = F.broadcast(results) if small_results else results
    return payload.join(side, on).drop(BUCKET)
