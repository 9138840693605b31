"""Named queries over a data directory, one per operator of the inventory.

Every query reads the Parquet tables of ``data_dir`` (or tables Spark
derives from them) in full. Scores are rounded to 6 places (9 for corpus
statistics) so that two engines summing in a different order agree; ranks
use the 1e-9 rank key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import inflections
from quarry.functions.text import basic_clean, join_tokens, split_tokens, tokenize
from quarry.functions.vectors import l2_normalize
from quarry.operators.analyze import DEFAULT_ANALYZER, query_terms
from quarry.operators.bm25 import bm25_hits
from quarry.operators.encoder import HashingEncoder, encode
from quarry.operators.fitted import FittedEncoder, fit_encoder
from quarry.operators.fusion import fuse, url_aliases
from quarry.operators.evaluate import (DEFAULT_KS, counts, first_query_examples, latency_summary,
                                       mean_latency, metrics_at_k, top_documents)
from quarry.operators.index import doc_terms, term_frequencies
from quarry.operators.lemmas import LONGEST, LemmaGuesser
from quarry.operators.relevance import (overlap_scorer, reciprocal_rank_fusion, relevance_at_k,
                                        rerank, term_judgements)
from quarry.operators.sentences import SentenceModel, sentence_tokens
from quarry.plans.engine import engine_for, table_state
from quarry.plans.evaluation import EXAMPLE_TOP_K, method_runs
from quarry.plans.search import RESULT_COLUMNS
from quarry.sources import tables
from quarry.params import METHODS, check_weights
from quarry.sources.jsonl import classify_lines, read_jsonl_strict
from quarry.session import scratch_path, spread, write_parquet
from quarry.sources.queries import read_query_lines, reference_queries
from quarry.sources.sinks import id_mapping, write_documents, write_embeddings, write_tables

SCORE_DIGITS = 6
STAT_DIGITS = 9
TEXT_K = 10
VECTOR_K = 10
HYBRID_K = 5
ENCODER_DIM = 64
# A small lemma table over forms of the test corpus.
LEMMAS = (("tion", "ti"), ("ing", "in"), ("ly", "li"), ("ble", "bl"), ("ou", "o"),
          ("chen", "ch"), ("keit", "heit"), ("ment", "men"), ("ción", "cion"), ("aux", "au"))


def _engine(spark, d):
    return engine_for(spark, d)


def _queries(spark, d):
    return tables.benchmark_queries(spark, d)


def _qvecs(spark, d):
    return tables.benchmark_query_vectors(spark, d)


def _scored(df: DataFrame, col: str = "score", digits: int = SCORE_DIGITS) -> DataFrame:
    return df.withColumn(col, F.round(col, digits))


# -- corpus preparation -----------------------------------------------------
def q_prepare_documents(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).corpus


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents table, spread by key when it comes in too few splits."""
    return spread(tables.table(spark, d, "documents"), "doc_id")


def q_basic_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return docs.select("doc_id", basic_clean("text").alias("clean_text"))


def q_doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = _documents(spark, d).select("doc_id", tokenize(basic_clean("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                       join_tokens("t").alias("tokens"))


def q_doc_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = _documents(spark, d).select(
        "doc_id", DEFAULT_ANALYZER.document_tokens("text", "lang").alias("t"))
    return terms.select("doc_id", F.size("t").cast("long").alias("n_terms"),
                        join_tokens("t").alias("terms"))


def q_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return query_terms(_queries(spark, d))


def _lemma_engine(spark: SparkSession, d: str):
    rows = ", ".join(f"('{f}', '{t}')" for f, t in LEMMAS)
    return engine_for(spark, d, lemmas=spark.sql(f"SELECT * FROM VALUES {rows} AS t(form, lemma)"))


def q_doc_terms_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """B6 + B9: analysed documents with lemmas."""
    corpus = _lemma_engine(spark, d).corpus
    return corpus.select("doc_id", F.size(split_tokens("text_processed")).cast("long")
                         .alias("n_terms"), F.col("text_processed").alias("terms"))


def q_text_search_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """B6 + B10 + J1: lemmas in documents and queries."""
    return _scored(_lemma_engine(spark, d).text(_queries(spark, d), TEXT_K))


_GUESSERS: dict[str, LemmaGuesser] = {}


def _guesser(spark: SparkSession) -> LemmaGuesser:
    """Fitted once per application on the inflection table."""
    app = spark.sparkContext.applicationId
    if app not in _GUESSERS:
        _GUESSERS[app] = LemmaGuesser.fit(spark.createDataFrame(
            inflections.pairs(), "form string, lemma string"))
    return _GUESSERS[app]


def q_lemma_guesses(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas of the distinct terms of all documents, known or guessed."""
    terms = _documents(spark, d).select(
        F.explode(tokenize(basic_clean("text"))).alias("term"))
    return _guesser(spark).table_for(terms)


def q_lemma_endings(spark: SparkSession, d: str) -> DataFrame:
    """The trie of endings, with the number of the documents' distinct
    terms that end so."""
    terms = _documents(spark, d).select(
        F.explode(tokenize(basic_clean("text"))).alias("term")).distinct()
    nodes = _guesser(spark).nodes
    sizes = F.sequence(F.lit(1), F.least(F.char_length("term"), F.lit(LONGEST)))
    met = terms.select(F.explode(F.transform(sizes, lambda n: F.right("term", n))).alias("ending"))
    counted = met.groupBy("ending").agg(F.count(F.lit(1)).alias("n_terms"))
    return nodes.join(counted, "ending", "left").select(
        "ending", "cut", "addition", "votes", "forms",
        F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))


def q_doc_terms_guessed(spark: SparkSession, d: str) -> DataFrame:
    """B6 + B9: analysed documents with lemmas of all terms, unseen ones too."""
    corpus = engine_for(spark, d, lemmas=_guesser(spark)).corpus
    return corpus.select("doc_id", F.size(split_tokens("text_processed")).cast("long")
                         .alias("n_terms"), F.col("text_processed").alias("terms"))


def q_text_search_guessed(spark: SparkSession, d: str) -> DataFrame:
    """B6 + B10 + J1 with guessed lemmas in documents and queries."""
    return _scored(engine_for(spark, d, lemmas=_guesser(spark)).text(_queries(spark, d), TEXT_K))


_SENTENCES: dict[tuple, tuple[DataFrame, SentenceModel]] = {}


def _sentences(spark: SparkSession, d: str) -> tuple[DataFrame, SentenceModel]:
    """``(doc_id, clean)`` of all documents, written down as every pass reads it,
    and its tables; once per application and table state."""
    key = (spark.sparkContext.applicationId, d,
           table_state(spark, f"{d.rstrip('/')}/documents.parquet"))
    if key not in _SENTENCES:
        clean = write_parquet(
            _documents(spark, d).select("doc_id", basic_clean("text").alias("clean")),
            scratch_path(spark, "sentence-texts"))
        _SENTENCES[key] = clean, SentenceModel.fit(clean, "clean", ready=True)
    return _SENTENCES[key]


def q_sentence_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Every type that occurs with a period, and its score."""
    return _scored(_sentences(spark, d)[1].abbreviations)


def q_sentence_starters(spark: SparkSession, d: str) -> DataFrame:
    """Every type after a clear sentence end, and its score."""
    return _scored(_sentences(spark, d)[1].starters)


def q_sentence_collocations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs across periods that may not end a sentence, and their score."""
    return _scored(_sentences(spark, d)[1].collocations)


def q_doc_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and their tokens, of every document."""
    clean, model = _sentences(spark, d)
    found = sentence_tokens(clean, model, "doc_id", "clean", ready=True)
    lines = F.transform("sentences", lambda s: F.array_join(s, " "))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"),
                        F.aggregate("sentences", F.lit(0).cast("long"),
                                    lambda n, s: n + F.size(s)).alias("n_tokens"),
                        F.array_join(lines, " | ").alias("tokens"))


# -- index statistics ---------------------------------------------------------
def q_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    corpus = _engine(spark, d).corpus
    return term_frequencies(doc_terms(corpus)).select("doc_id", "term", "tf")


def q_doc_length(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).index.docs.select("doc_id", "dl")


def q_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = _engine(spark, d).index.stats_frame()
    return stats.select("n_docs", "total_tokens", F.round("avgdl", STAT_DIGITS).alias("avgdl"),
                        "n_terms", F.round("avg_idf", STAT_DIGITS).alias("avg_idf"))


def q_term_idf(spark: SparkSession, d: str) -> DataFrame:
    terms = _engine(spark, d).index.terms.select("term", "df", "idf")
    return _scored(terms, "idf", STAT_DIGITS)


def q_bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    eng = _engine(spark, d)
    hits = bm25_hits(eng.index, query_terms(_queries(spark, d)))
    return _scored(hits, "raw")


# -- search -------------------------------------------------------------------
def q_text_search(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_engine(spark, d).text(_queries(spark, d), TEXT_K))


def q_text_search_pruned(spark: SparkSession, d: str) -> DataFrame:
    """J1 with block-max bounds and essential terms."""
    return _scored(_engine(spark, d).text(_queries(spark, d), TEXT_K, pruned=True))


def page_url_queries(spark: SparkSession, d: str) -> DataFrame:
    """URLs of ``pages`` as queries: few of their terms occur in the corpus,
    so most lists are short and end in zero-score padding."""
    p = tables.table(spark, d, "pages")
    return p.select(F.col("page_id").alias("query_id"), F.col("url").alias("query"),
                    F.lit("").alias("description"))


def q_text_search_padded(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_engine(spark, d).text(page_url_queries(spark, d), TEXT_K))


def q_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = tables.table(spark, d, "embeddings")
    unit = e.select(F.col("vec_id"), l2_normalize("embedding").alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("pos", "value")).withColumn(
        "value", F.round("value", STAT_DIGITS))


def q_vector_search(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_engine(spark, d).vector(_qvecs(spark, d), VECTOR_K))


def q_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).hybrid(_queries(spark, d), _qvecs(spark, d), HYBRID_K)


def q_hybrid_search_w70_30(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).hybrid(_queries(spark, d), _qvecs(spark, d), HYBRID_K,
                                    weights={"bm25": 0.7, "vector": 0.3})


def q_hybrid_search_shared_urls(spark: SparkSession, d: str) -> DataFrame:
    """J3 where each two neighbouring documents have one URL."""
    eng = _engine(spark, d)
    shared = eng.corpus.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 2)
                               .cast("string").alias("url"))
    eng = replace(eng, aliases=url_aliases(shared))
    ranked = eng.hybrid_ranked(_queries(spark, d), _qvecs(spark, d), HYBRID_K)
    return ranked.select("query_id", "rank", "doc_id", "score", "score_type")


def q_hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """E5 + F1: the fused candidate list (depth 2k per side) before the cut."""
    eng = _engine(spark, d)
    q, qv = _queries(spark, d), _qvecs(spark, d)
    depth = 2 * HYBRID_K
    fused = fuse(eng.text_ranked(q, depth), eng.vector_ranked(qv, depth),
                 check_weights(None))
    return _scored(fused.select("query_id", "doc_id", "fused", "score_type",
                                "src", "src_rank"), "fused")


def q_jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """A1 + B1 + B12 over JSON lines that Spark writes from ``documents``."""
    raw = tables.raw_documents(spark, d)
    lines = raw.select(F.to_json(F.struct("url", "date", "title", "summary", "text"))
                       .alias("value"))
    parsed = classify_lines(lines)
    return parsed.where(F.col("reason").isNull()).select(
        "url", "date", "title", "summary", "text")


def q_jsonl_rejects(spark: SparkSession, d: str) -> DataFrame:
    """A1 + B1 + B12 where every line but one in seven is broken, lacks a field,
    is no object, has a null and a number for strings, a key twice, or NaN; what
    became of them."""
    raw = tables.raw_documents(spark, d)
    full = F.struct("url", "date", "title", "summary", "text")
    kind = F.pmod("doc_id", F.lit(7))
    whole = F.to_json(full)
    line = (F.when(kind == 0, F.substring(whole, F.lit(1), F.length(whole) - 1))
            .when(kind == 1, F.to_json(F.struct("url", "date", "title", "summary")))
            .when(kind == 2, F.to_json(F.array("url")))
            .when(kind == 3, F.to_json(
                F.struct("url", "date", F.lit(None).cast("string").alias("title"),
                         F.col("doc_id").alias("summary"), "text"), {"ignoreNullFields": "false"}))
            .when(kind == 5, F.concat(F.lit('{"title":"first",'), F.substring(whole, 2, 1 << 30)))
            .when(kind == 6, F.concat(F.lit('{"n":NaN,'), F.substring(whole, 2, 1 << 30)))
            .otherwise(whole))
    parsed = classify_lines(raw.select(line.alias("value")))
    return parsed.groupBy(F.coalesce("reason", F.lit("good")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("reason").isNull(), F.length("title")).otherwise(0)).alias("title_chars"),
        F.sum(F.when(F.col("reason").isNull(), F.length("summary")).otherwise(0))
        .alias("summary_chars"),
        F.sum(F.when(F.col("reason").isNull(), F.length("text")).otherwise(0)).alias("text_chars"))


def q_documents_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A4 + A2: the prepared corpus as JSON lines, read back by the strict scan."""
    path = scratch_path(spark, "documents-json")
    write_documents(_engine(spark, d).corpus, path, "json")
    return read_jsonl_strict(spark, path)


def q_embeddings_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A5 + A3."""
    path = scratch_path(spark, "embeddings")
    write_embeddings(tables.embeddings(spark, d), path)
    return spark.read.parquet(path).select(
        "doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), SCORE_DIGITS))


def q_evaluation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The metrics table written and read back."""
    path = scratch_path(spark, "evaluation")
    write_tables({"metrics": q_eval_metrics_at_k(spark, d)}, path)
    return spark.read.parquet(path + "/metrics")


def q_query_lines(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark texts as a file of lines."""
    path = scratch_path(spark, "query-lines")
    tables.table(spark, d, "benchmark").select(F.concat(F.lit("  "), "text")).write.text(path)
    lines = read_query_lines(spark, path)
    return lines.groupBy("query", "description").agg(
        F.countDistinct("query_id").alias("n_ids"))


def q_text_search_reference(spark: SparkSession, d: str) -> DataFrame:
    """A7 + J1: the fixed evaluation queries, with their descriptions."""
    q = reference_queries(spark)
    found = _engine(spark, d).text(q, HYBRID_K)
    return _scored(found).join(q.select("query_id", "description"), "query_id").select(
        "query_id", "description", "rank", "doc_id", "title", "score")


def q_search_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """J4 for each of the three methods."""
    eng, q, qv = _engine(spark, d), _queries(spark, d), _qvecs(spark, d)
    out = [eng.search(q, m, HYBRID_K, query_vectors=qv).select(
        F.lit(m).alias("method"), "query_id", "rank", "doc_id") for m in METHODS]
    return out[0].union(out[1]).union(out[2])


def q_hybrid_top1_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """Rank 1 of a hybrid list depends on top_k (candidates at depth 2k)."""
    eng = _engine(spark, d)
    q, qv = _queries(spark, d), _qvecs(spark, d)
    k1 = eng.hybrid_ranked(q, qv, 1).select("query_id", F.col("doc_id").alias("doc_k1"),
                                            F.col("score").alias("score_k1"))
    k10 = eng.hybrid_ranked(q, qv, 10).where(F.col("rank") == 1).select(
        "query_id", F.col("doc_id").alias("doc_k10"), F.col("score").alias("score_k10"))
    return k1.join(k10, "query_id", "full")


def q_id_mapping(spark: SparkSession, d: str) -> DataFrame:
    eng = _engine(spark, d)
    docs = eng.index.docs.join(eng.corpus.select("doc_id", "url"), "doc_id")
    return id_mapping(docs)


# -- evaluation -----------------------------------------------------------------
def q_eval_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    eng = _engine(spark, d)
    q, qv = _queries(spark, d), _qvecs(spark, d)
    methods = ("vector", "text", "hybrid")
    runs = method_runs(eng, q, qv, 10, methods)
    m = metrics_at_k(runs, q, methods)
    # Means of 4-place hybrid scores end on a tie at the 7th place; 9 places
    # keep clear of ties for these denominators.
    for c in ("avg_score", "max_score", "min_score"):
        m = m.withColumn(c, F.round(c, STAT_DIGITS))
    return m


def q_eval_top_document(spark: SparkSession, d: str) -> DataFrame:
    eng = _engine(spark, d)
    runs = method_runs(eng, _queries(spark, d), _qvecs(spark, d), EXAMPLE_TOP_K)
    return _scored(top_documents(runs, eng.corpus))


def q_eval_examples_top3(spark: SparkSession, d: str) -> DataFrame:
    eng = _engine(spark, d)
    q = _queries(spark, d)
    runs = method_runs(eng, q, _qvecs(spark, d), EXAMPLE_TOP_K)
    return _scored(first_query_examples(runs, q, eng.corpus, EXAMPLE_TOP_K))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """A run log ``(method, k, run, seconds_per_query)`` read off ``events``:
    the event's type stands for the method, its user for the cut-off."""
    e = tables.table(spark, d, "events")
    ks = F.array(*[F.lit(k) for k in DEFAULT_KS])
    return e.select(F.col("event_type").alias("method"),
                    F.element_at(ks, (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("k"),
                    F.col("event_id").alias("run"),
                    (F.col("value") / 1000).alias("seconds_per_query"))


def _rounded_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, STAT_DIGITS) for c in ("avg_time", "std_time")})


def q_eval_latency(spark: SparkSession, d: str) -> DataFrame:
    """F5 over a run log."""
    return _rounded_times(latency_summary(run_log(spark, d)))


def q_eval_mean_latency(spark: SparkSession, d: str) -> DataFrame:
    """F6 over a run log."""
    return _rounded_times(mean_latency(latency_summary(run_log(spark, d))))


def q_rrf_search(spark: SparkSession, d: str) -> DataFrame:
    """Text and vector lists (depth 2k) fused by rank."""
    eng, q, qv = _engine(spark, d), _queries(spark, d), _qvecs(spark, d)
    depth = 2 * HYBRID_K
    lists = [eng.text_ranked(q, depth), eng.vector_ranked(qv, depth)]
    return _scored(reciprocal_rank_fusion(lists, HYBRID_K))


def q_relevance_at_k(spark: SparkSession, d: str) -> DataFrame:
    """R2: precision, recall and NDCG of the three methods."""
    eng, q, qv = _engine(spark, d), _queries(spark, d), _qvecs(spark, d)
    methods = ("vector", "text", "hybrid")
    judged = write_parquet(term_judgements(eng.index, eng.query_terms(q)),
                           scratch_path(spark, "judged"))
    found = relevance_at_k(method_runs(eng, q, qv, TEXT_K, methods), judged, q, methods, DEFAULT_KS)
    return found.withColumns({c: F.round(c, SCORE_DIGITS) for c in ("precision", "recall", "ndcg")})


def q_rerank_search(spark: SparkSession, d: str) -> DataFrame:
    """The text list at depth 2k, ranked again on the documents' cleaned texts."""
    eng, q = _engine(spark, d), _queries(spark, d)
    found = rerank(eng.text_ranked(q, 2 * HYBRID_K), q, eng.corpus, overlap_scorer, HYBRID_K)
    return _scored(found)


def q_corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(_engine(spark, d).corpus, _queries(spark, d))


def q_encode_documents(spark: SparkSession, d: str) -> DataFrame:
    """The encoder hook over the cleaned body of every document."""
    corpus = _engine(spark, d).corpus
    vectors = encode(corpus.select("doc_id", "text"), HashingEncoder(ENCODER_DIM),
                     text_col="text", key="doc_id")
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), SCORE_DIGITS))


def q_vector_search_encoded(spark: SparkSession, d: str) -> DataFrame:
    """C1 + C2 + J2: documents and queries embedded by the same encoder."""
    eng = engine_for(spark, d, encoder=HashingEncoder(ENCODER_DIM))
    return _scored(eng.search(_queries(spark, d), "vector", VECTOR_K))


_FITTED: dict[tuple, FittedEncoder] = {}


def _fitted(spark: SparkSession, d: str) -> FittedEncoder:
    """Fitted on the cleaned bodies of all documents, once per table state."""
    key = (spark.sparkContext.applicationId, d,
           table_state(spark, f"{d.rstrip('/')}/documents.parquet"))
    if key not in _FITTED:
        _FITTED[key] = fit_encoder(_engine(spark, d).corpus)
    return _FITTED[key]


def q_encode_documents_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Latent vectors of the cleaned body of every document."""
    vectors = encode(_engine(spark, d).corpus.select("doc_id", "text"), _fitted(spark, d),
                     text_col="text", key="doc_id")
    return vectors.select("doc_id", F.transform(
        "embedding", lambda x: F.round(x.cast("double"), SCORE_DIGITS)).alias("embedding"))


def q_vector_search_fitted(spark: SparkSession, d: str) -> DataFrame:
    """C1 + C2 + J2 with the fitted encoder for documents and queries."""
    eng = engine_for(spark, d, encoder=_fitted(spark, d))
    return _scored(eng.search(_queries(spark, d), "vector", VECTOR_K))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "prepare_documents": q_prepare_documents,
    "basic_clean": q_basic_clean,
    "doc_tokens": q_doc_tokens,
    "doc_terms": q_doc_terms,
    "sentence_abbreviations": q_sentence_abbreviations,
    "sentence_starters": q_sentence_starters,
    "sentence_collocations": q_sentence_collocations,
    "doc_sentences": q_doc_sentences,
    "query_terms": q_query_terms,
    "doc_terms_lemmas": q_doc_terms_lemmas,
    "text_search_lemmas": q_text_search_lemmas,
    "lemma_endings": q_lemma_endings,
    "lemma_guesses": q_lemma_guesses,
    "doc_terms_guessed": q_doc_terms_guessed,
    "text_search_guessed": q_text_search_guessed,
    "term_frequency": q_term_frequency,
    "doc_length": q_doc_length,
    "corpus_stats": q_corpus_stats,
    "term_idf": q_term_idf,
    "bm25_scores": q_bm25_scores,
    "text_search": q_text_search,
    "text_search_pruned": q_text_search_pruned,
    "text_search_padded": q_text_search_padded,
    "l2_normalize": q_l2_normalize,
    "vector_search": q_vector_search,
    "hybrid_search": q_hybrid_search,
    "hybrid_search_w70_30": q_hybrid_search_w70_30,
    "hybrid_search_shared_urls": q_hybrid_search_shared_urls,
    "hybrid_candidates": q_hybrid_candidates,
    "hybrid_top1_by_depth": q_hybrid_top1_by_depth,
    "jsonl_scan": q_jsonl_scan,
    "jsonl_rejects": q_jsonl_rejects,
    "documents_round_trip": q_documents_round_trip,
    "embeddings_round_trip": q_embeddings_round_trip,
    "evaluation_round_trip": q_evaluation_round_trip,
    "query_lines": q_query_lines,
    "text_search_reference": q_text_search_reference,
    "search_dispatch": q_search_dispatch,
    "id_mapping": q_id_mapping,
    "eval_metrics_at_k": q_eval_metrics_at_k,
    "eval_top_document": q_eval_top_document,
    "eval_examples_top3": q_eval_examples_top3,
    "eval_latency": q_eval_latency,
    "eval_mean_latency": q_eval_mean_latency,
    "rrf_search": q_rrf_search,
    "relevance_at_k": q_relevance_at_k,
    "rerank_search": q_rerank_search,
    "corpus_counts": q_corpus_counts,
    "encode_documents": q_encode_documents,
    "vector_search_encoded": q_vector_search_encoded,
    "encode_documents_fitted": q_encode_documents_fitted,
    "vector_search_fitted": q_vector_search_fitted,
}

__all__ = ["QUERIES", "RESULT_COLUMNS"]
