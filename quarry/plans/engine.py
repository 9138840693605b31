"""Build a :class:`SearchEngine` from a data directory (the Parquet tables of
``quarry.sources.tables``), once per session and directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.analyze import DEFAULT_ANALYZER, Analyzer
from quarry.operators.index import build_index
from quarry.operators.encoder import encoder_key
from quarry.operators.fusion import url_aliases
from quarry.operators.lemmas import LemmaGuesser
from quarry.operators.payload import build_payload
from quarry.plans.corpus import build_corpus, build_vectors, encode_corpus
from quarry.plans.search import SearchEngine
from quarry.session import scratch_path, write_parquet
from quarry.sources import tables

_ENGINES: dict = {}


def table_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files, so that a changed table
    isn't served from an older engine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime())
                        for f in files))


def engine_for(spark: SparkSession, data_dir: str, analyzer: Analyzer = DEFAULT_ANALYZER,
               path: str | None = None, cache: bool = True,
               encoder=None, lemmas: DataFrame | LemmaGuesser | None = None) -> SearchEngine:
    """Corpus, index and vectors of ``data_dir``, written under ``path`` (by
    default a new folder in the checkpoint directory).

    Document vectors come from the ``embeddings`` table, or, when an encoder
    factory is given, from encoding the cleaned body of every document (the
    same encoder then embeds the queries). A ``lemmas(form, lemma)`` table or a
    ``LemmaGuesser`` is applied to the documents here and to the queries of
    every search.
    """
    base_dir = data_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, base_dir, path, analyzer,
           *(table_state(spark, f"{base_dir}/{t}.parquet") for t in ("documents", "embeddings")),
           encoder_key(encoder) if encoder is not None else None,
           lemmas.semanticHash() if lemmas is not None else None)
    if cache and key in _ENGINES:
        return _ENGINES[key]
    if encoder is not None:
        # Same corpus and index; only the document vectors differ.
        base_engine = engine_for(spark, data_dir, analyzer, path, cache, lemmas=lemmas)
        vectors = encode_corpus(base_engine.corpus, encoder,
                                scratch_path(spark, "encoded-vectors"))
        engine = SearchEngine(corpus=base_engine.corpus, index=base_engine.index,
                              doc_vectors=vectors, analyzer=analyzer, encoder=encoder,
                              payload=base_engine.payload, aliases=base_engine.aliases,
                              lemmas=lemmas)
        if cache:
            _ENGINES[key] = engine
        return engine
    base = path or scratch_path(spark, "engine")
    corpus = build_corpus(tables.raw_documents(spark, data_dir), base + "/corpus", analyzer,
                          lemmas=lemmas)
    index = build_index(corpus, base + "/index")
    vectors = build_vectors(tables.embeddings(spark, data_dir), corpus, base + "/vectors")
    payload = build_payload(corpus, base + "/payload")
    aliases = write_parquet(url_aliases(corpus), base + "/aliases")
    engine = SearchEngine(corpus=corpus, index=index, doc_vectors=vectors, analyzer=analyzer,
                          payload=payload, aliases=aliases, lemmas=lemmas)
    if cache:
        _ENGINES[key] = engine
    return engine
