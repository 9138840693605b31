"""End-to-end plans: corpus build, search, evaluation."""

from quarry.plans.corpus import build_corpus, build_index, build_vectors
from quarry.plans.engine import engine_for
from quarry.plans.evaluation import evaluate, measure_latency, method_runs
from quarry.plans.search import SearchEngine, nest_results

__all__ = ["build_corpus", "build_index", "build_vectors", "engine_for", "evaluate",
           "measure_latency", "method_runs", "SearchEngine", "nest_results"]
