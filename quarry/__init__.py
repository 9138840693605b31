"""quarry: ranked retrieval (BM25, exact vector, hybrid) as Spark DataFrame jobs."""

from quarry.operators.analyze import Analyzer, prepare_documents, query_terms
from quarry.operators.index import Bm25Index, build_index
from quarry.params import check_method, check_top_k, check_weights
from quarry.plans.corpus import build_corpus, build_vectors
from quarry.plans.engine import engine_for
from quarry.plans.evaluation import evaluate
from quarry.plans.search import SearchEngine
from quarry.session import local_session

__all__ = [
    "Analyzer", "prepare_documents", "query_terms", "Bm25Index", "build_index",
    "check_method", "check_top_k", "check_weights", "build_corpus", "build_vectors",
    "engine_for", "evaluate", "SearchEngine", "local_session",
]
