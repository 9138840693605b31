"""Column-level building blocks (text cleaning, tokenising, vectors)."""

from quarry.functions.stopwords import BY_LANGUAGE, LANGUAGES, stopwords_for
from quarry.functions.text import (
    as_text,
    basic_clean,
    drop_stopwords,
    join_tokens,
    keep_letter_tokens,
    rank_key,
    snippet,
    split_tokens,
    tokenize,
)
from quarry.functions.vectors import dot, l2_norm, l2_normalize

__all__ = [
    "BY_LANGUAGE", "LANGUAGES", "stopwords_for", "as_text", "basic_clean",
    "drop_stopwords", "join_tokens", "keep_letter_tokens", "rank_key", "snippet",
    "split_tokens", "tokenize", "dot", "l2_norm", "l2_normalize",
]
