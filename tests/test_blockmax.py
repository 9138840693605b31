import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.blockmax import build_blocks, pruned_hits, text_top_k_pruned
from quarry.operators.bm25 import bm25_hits, text_top_k
from quarry.operators.index import build_index


def corpus(spark, seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 10, 60])))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(min(n, 20))]   # ties
    return spark.createDataFrame(rows, "doc_id long, text_processed string")


def queries(spark, seed, n=25):
    rng = random.Random(seed)
    rows = [(i, f"w{rng.randrange(70)}", rng.choice([1, 1, 2])) for i in range(n)
            for _ in range(rng.randint(1, 6))]
    rows = [(q, t, f) for (q, t), f in {(q, t): f for q, t, f in rows}.items()]
    qterms = spark.createDataFrame(rows + [(None, "w1", 1), (90, "", 1)],
                                   "query_id long, term string, qtf long")
    return spark.createDataFrame([(i,) for i in [*range(n), 90, 91]], "query_id long"), qterms


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("block_docs,k", [(8, 5), (64, 1), (1, 10), (1000, 3)])
def test_same_rows_as_the_whole_search(spark, block_docs, k):
    index = build_index(corpus(spark, block_docs))
    blocks = build_blocks(index, block_docs=block_docs)
    qs, qterms = queries(spark, k)
    for pad in (True, False):
        assert rows_of(text_top_k_pruned(index, blocks, qs, qterms, k, pad)) == rows_of(
            text_top_k(index, qs, qterms, k, pad))


def test_blocks_hold_every_posting_once(spark):
    index = build_index(corpus(spark, 7))
    table = build_blocks(index, block_docs=16).table
    each = table.select("term", "dblock", "max_part", F.explode("entries").alias("e"))
    got = sorted((r["term"], r["e"]["doc_id"], r["e"]["part"]) for r in each.collect())
    want = sorted((r["term"], r["doc_id"], r["part"]) for r in index.postings.collect())
    assert got == want
    assert each.where("e.part > max_part").count() == 0
    assert table.groupBy("term", "dblock").count().where("count > 1").count() == 0
    assert each.groupBy("e.doc_id").agg(F.countDistinct("dblock").alias("n")).where("n > 1").count() == 0


def test_fewer_postings_are_summed(spark):
    index = build_index(corpus(spark, 3, 3000))
    blocks = build_blocks(index, block_docs=32)
    rows = [(q, t, 1) for q in range(6) for t in (f"w{40 + q}", "w0", "w1", "w2")]
    qterms = spark.createDataFrame(rows, "query_id long, term string, qtf long")
    whole = index.postings.join(qterms, "term").count()
    read = pruned_hits(index, blocks, qterms, 3).agg(F.sum("read")).first()[0]
    assert read < whole / 3
    best = bm25_hits(index, qterms).groupBy("query_id").agg(F.max("raw")).collect()
    found = pruned_hits(index, blocks, qterms, 3).groupBy("query_id").agg(F.max("raw")).collect()
    assert {r[0]: round(r[1], 9) for r in best} == {r[0]: round(r[1], 9) for r in found}


def test_empty_corpus_and_no_queries(spark):
    index = build_index(corpus(spark, 1, 0))
    qs, qterms = queries(spark, 1)
    assert text_top_k_pruned(index, build_blocks(index), qs, qterms, 3).count() == 0
    index = build_index(corpus(spark, 1, 50))
    none = text_top_k_pruned(index, build_blocks(index), qs.limit(0), qterms.limit(0), 3)
    assert none.count() == 0
