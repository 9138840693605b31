"""Search a stream of queries against a built engine.

The searches are batch operators over a query table; a stream of queries
(one micro-batch at a time) is served by ``foreachBatch``, each micro-batch
being one query table. Results are appended to a Parquet sink; the stream's
checkpoint (under the cluster's checkpoint directory unless given) makes a
restarted query resume after the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.params import check_method, check_top_k
from quarry.plans.search import SearchEngine
from quarry.session import scratch_path


def search_batch(engine: SearchEngine, queries: DataFrame, method: str, top_k: int,
                 weights: dict | None = None,
                 query_vectors: DataFrame | None = None) -> DataFrame:
    """One micro-batch: the results of ``method`` for the batch's queries."""
    return engine.search(queries, method, top_k, weights, query_vectors)


def start_search_stream(engine: SearchEngine, query_stream: DataFrame, output_path: str,
                        method: str = "text", top_k: int = 5, weights: dict | None = None,
                        vectors_for=None, checkpoint_location: str | None = None,
                        trigger: dict | None = None) -> StreamingQuery:
    """Start a streaming query that searches every micro-batch of
    ``query_stream(query_id, query, ...)`` and appends the results, with the
    batch id, to Parquet at ``output_path``.

    ``vectors_for(batch_df) -> DataFrame(query_id, embedding)`` supplies query
    vectors for the vector and hybrid methods (an encoder, or a lookup).
    """
    check_method(method)
    check_top_k(top_k)
    spark = query_stream.sparkSession
    checkpoint_location = checkpoint_location or scratch_path(spark, "search-stream")

    def run(batch: DataFrame, batch_id: int) -> None:
        qv = vectors_for(batch) if vectors_for is not None and method != "text" else None
        out = search_batch(engine, batch, method, top_k, weights, qv)
        # A batch replayed after a failure replaces its own folder.
        out.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")

    writer = (query_stream.writeStream.foreachBatch(run)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
