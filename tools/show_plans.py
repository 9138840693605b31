"""Print the executed (AQE final) physical plans of the headline queries.

Usage: python tools/show_plans.py [data_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quarry.plans.engine import engine_for  # noqa: E402
from quarry.session import local_session  # noqa: E402
from quarry.sources import tables  # noqa: E402


def main():
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    eng = engine_for(spark, data_dir)
    q = tables.benchmark_queries(spark, data_dir)
    qv = tables.benchmark_query_vectors(spark, data_dir)
    one = q.orderBy("query_id").limit(1)
    many = q                                           # 3 copies: > 1,024 result rows
    for c in (1, 2):
        many = many.unionByName(q.selectExpr(f"query_id + {c} * 1000000 AS query_id",
                                             "query", "description"))
    for name, make in [("text_ranked", lambda: eng.text_ranked(q, 10)),
                       ("vector_ranked", lambda: eng.vector_ranked(qv, 10)),
                       ("hybrid_ranked", lambda: eng.hybrid_ranked(q, qv, 5)),
                       ("text_search_large_batch", lambda: eng.text(many, 10)),
                       ("text_search_single_query", lambda: eng.text(one, 10))]:
        df = make()
        df.collect()
        print(f"===== {name} =====")
        df.explain()


if __name__ == "__main__":
    main()
