"""Relational operators of the search engine (DataFrame in, DataFrame out)."""
