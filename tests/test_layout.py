"""Sizing rules of the postings layout (document buckets, term buckets)."""

from quarry.operators.index import (
    MAX_DOC_BUCKETS,
    POSTING_BYTES_PER_TOKEN,
    TARGET_FILE_BYTES,
    TOKENS_PER_DOC_BUCKET,
    doc_bucket_count,
    term_bucket_count,
)


def test_term_buckets_target_file_size():
    assert term_bucket_count(3_424_166, 8) == 1                 # sf0.1: one bucket
    # 100 TB of text (about 2e13 tokens) over 20,000 document buckets:
    n = term_bucket_count(2 * 10**13, 20_000)
    assert n > 1
    per_file = 2 * 10**13 * POSTING_BYTES_PER_TOKEN / (20_000 * n)
    assert per_file >= TARGET_FILE_BYTES                        # no flood of small files
    assert term_bucket_count(0, 1) == 1


def test_doc_buckets_follow_tokens_not_session_settings(spark):
    assert doc_bucket_count(spark, 0) == spark.sparkContext.defaultParallelism
    assert doc_bucket_count(spark, 10**10) == 10**10 // TOKENS_PER_DOC_BUCKET


def test_doc_buckets_stay_below_sparks_bound(spark):
    # 100 TB of text: Spark refuses more than 100,000 buckets.
    n = doc_bucket_count(spark, 2 * 10**13)
    assert n == MAX_DOC_BUCKETS < 100_000
    assert term_bucket_count(2 * 10**13, n) > 10
