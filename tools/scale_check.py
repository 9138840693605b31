"""Scaling check: replicate the documents of a data directory R times (new
keys, same text; Spark does the replication), build corpus and index, and
time a text search of the whole benchmark query table.

Usage: python tools/scale_check.py [data_dir] [R ...]   (default sf0.1, 1 10)
Writes under a fresh scratch folder of the checkpoint directory.
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from quarry.operators.index import build_index  # noqa: E402
from quarry.plans.corpus import build_corpus  # noqa: E402
from quarry.plans.search import SearchEngine  # noqa: E402
from quarry.session import local_session, scratch_path  # noqa: E402
from quarry.sources import tables  # noqa: E402


def main():
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    reps = [int(x) for x in sys.argv[2:]] or [1, 10]
    spark = local_session(8, 16)
    raw = tables.raw_documents(spark, data_dir)
    q = tables.benchmark_queries(spark, data_dir)
    for rep in reps:
        base = scratch_path(spark, f"scale-{rep}")
        copies = (raw.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(rep - 1))))
                  .withColumn("doc_id", F.col("doc_id") + F.col("_copy").cast("long") * 1_000_000_000)
                  .drop("_copy"))
        t0 = time.time()
        corpus = build_corpus(copies, base + "/corpus")
        t1 = time.time()
        index = build_index(corpus, base + "/index")
        t2 = time.time()
        eng = SearchEngine(corpus=corpus, index=index, doc_vectors=None)
        runs = []
        for _ in range(3):
            t3 = time.time()
            eng.text(q, 10).write.format("noop").mode("overwrite").save()
            runs.append(round(time.time() - t3, 2))
        print(f"copies={rep} docs={index.stats.n_docs} corpus_s={t1 - t0:.1f} "
              f"index_s={t2 - t1:.1f} text_search_s={runs} doc_buckets={index.stats.n_doc_buckets} "
              f"term_buckets={index.stats.n_buckets}")


if __name__ == "__main__":
    main()
