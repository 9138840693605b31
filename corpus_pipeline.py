"""Documents to packed sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet under the shared checkpoint folder and rereads it for
the next one. All stages but the last return the columns of ``documents`` in
their order, whatever further columns there are; ``n_chars`` follows the text.

Defined results: null or empty texts pass through (the classifier may reject
them); of rows that repeat an id and text near-duplicate removal keeps one; an
empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import cotraining, packing, secrets, simhash, substrings
from quarry.llm.common import staged, table, whole_text

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def held(docs: DataFrame) -> DataFrame:
    """The known columns; any others wait in one struct, whatever their names."""
    others = [c for c in docs.columns if c not in COLUMNS]
    extra = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others")] if others else []
    return docs.select(*COLUMNS, *extra)


def released(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as they were, with ``n_chars`` of the text as it is now."""
    return df.select(*[
        F.char_length(whole_text()).cast(df.schema["n_chars"].dataType).alias(c)
        if c == "n_chars" else F.col(c) if c in COLUMNS else F.col(f"_others.`{c}`")
        for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    rows = held(docs)
    model = cotraining.train(rows, table(spark, sf_dir, "labels"))
    return released(cotraining.score(rows, model).where("kept"), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    kept = staged(simhash.keepers(found), "keepers").toDF("_id", "_hash")
    rows = held(docs).withColumn("_text_hash", F.xxhash64(whole_text()))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id"))
                     & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    # Rows that repeat an id and its text are in the same partition already.
    copy = F.row_number().over(Window.partitionBy("doc_id", "_text_hash").orderBy("n_chars"))
    return released(rows.withColumn("_copy", copy).where("_copy = 1"), docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated 100-byte strings."""
    kept = substrings.remove_repeats(held(docs), as_text=True)
    return released(kept.withColumn("text", F.col("kept")), docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    rows = held(docs)
    model = secrets.train(secrets.labelled_samples(rows))
    return released(secrets.redact(rows, model), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of every document."""
    return packing.pack(packing.measured(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, trained models and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
