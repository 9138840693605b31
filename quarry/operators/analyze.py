"""Document and query analyzers, and document preparation.

Two analyzers, as the ranked-retrieval design has them:

* documents: basic clean -> lower -> tokenise -> drop stop words -> lemma
  (punctuation and digit tokens stay and count in the document length);
* queries: lower -> tokenise -> drop stop words and tokens without a letter
  -> lemma (no cleaning).

Stop words are tested on the surface form, before lemmatisation, and are those
of the row's language alone ("war" stays in English). Lemmas come
from an optional ``(form, lemma)`` table or from a ``LemmaGuesser``, which also
guesses those of forms it doesn't know; without either the form is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stopwords import BY_LANGUAGE
from quarry.functions.text import (
    as_text,
    basic_clean,
    bind,
    drop_stopwords,
    join_tokens,
    keep_letter_tokens,
    stop_language,
    tokenize,
)
from quarry.operators.lemmas import LemmaGuesser, guess
from quarry.session import (
    BROADCAST_ROW_LIMIT,
    bounded_broadcast,
    scratch_path,
    ship_package,
    write_parquet,
)


HELD_LEMMAS = 500_000   # forms and lemmas that a Python worker holds, some 100 MB at most


@dataclass(frozen=True)
class Analyzer:
    """Text analysis settings shared by documents and queries.

    ``lists`` are the stop words of each language. A row's are those of its
    own language: ``lang`` where it is given and has a list, else the language
    whose list holds most of the tokens (``functions.text.stop_language``).
    """

    lists: tuple[tuple[str, tuple[str, ...]], ...] = tuple(BY_LANGUAGE.items())

    @property
    def stopwords(self) -> dict[str, tuple[str, ...]]:
        return dict(self.lists)

    def language(self, tokens, lang=None, few: bool = False) -> Column:
        decided = stop_language(tokens, self.stopwords, few)
        if lang is None:
            return decided
        lang = F.col(lang) if isinstance(lang, str) else lang
        return F.coalesce(F.when(lang.isin(*self.stopwords), lang), decided)

    def document_tokens(self, text, lang=None) -> Column:
        return self.cleaned_tokens(basic_clean(text), lang)

    def cleaned_tokens(self, cleaned, lang=None) -> Column:
        """Document tokens of text that went through the basic clean already
        (the clean is idempotent, so this equals ``document_tokens``)."""
        return bind(tokenize(cleaned), lambda tokens: drop_stopwords(
            tokens, self.language(tokens, lang), self.stopwords))

    def query_tokens(self, text, lang=None) -> Column:
        return keep_letter_tokens(bind(tokenize(as_text(text)), lambda tokens: drop_stopwords(
            tokens, self.language(tokens, lang, few=True), self.stopwords, few=True)))


DEFAULT_ANALYZER = Analyzer()


def lemmatize_columns(df: DataFrame, key: str, columns: list[str],
                      lemmas: DataFrame | LemmaGuesser,
                      max_broadcast_rows: int = BROADCAST_ROW_LIMIT,
                      max_held_rows: int = HELD_LEMMAS) -> DataFrame:
    """Replace the tokens of several array columns by their lemmas from
    ``lemmas(form, lemma)``, or from a ``LemmaGuesser``.

    Order and repeats are kept; empty arrays stay empty. Within ``max_held_rows``
    rows of its own, every Python worker holds the guesser and no row moves,
    however many distinct tokens ``df`` has; above that it is asked for a table of
    them. Of a table only lemmas that differ from their forms are looked up.
    Within ``max_held_rows`` of them, every Python worker holds them in a hash
    table and no row moves. Above that, the distinct tokens of a row are joined to
    them and only those met cross the shuffle, by ``key``, which is unique per row.
    What reads ``df`` twice reads a written copy.
    """
    spark = df.sparkSession
    none = F.array().cast("array<string>")
    ship_package(spark)
    written = False
    if isinstance(lemmas, LemmaGuesser):
        model = lemmas.held(max_held_rows)
        if model is not None:
            listed = df.withColumns({c: F.coalesce(F.col(c), none) for c in columns})
            return listed.mapInArrow(guessed_lemmas(spark.sparkContext.broadcast(model), columns),
                                     listed.schema)
        df, written = write_parquet(df, scratch_path(spark, "analysed")), True
        tokens = F.concat(*[F.coalesce(F.col(c), none) for c in columns])
        lemmas = write_parquet(lemmas.table_for(df.select(F.explode(tokens).alias("term"))),
                               scratch_path(spark, "lemma-table"))
    table = lemmas.select("form", "lemma").dropDuplicates(["form"]).where("form <> lemma")
    table, rows, _ = bounded_broadcast(table, max_broadcast_rows)
    if rows <= min(max_held_rows, max_broadcast_rows):
        held = spark.sparkContext.broadcast([c.to_pylist() for c in table.toArrow().columns])
        listed = df.withColumns({c: F.coalesce(F.col(c), none) for c in columns})
        return listed.mapInArrow(held_lemmas(held, columns), listed.schema)
    if not written:
        df = write_parquet(df, scratch_path(spark, "analysed"))
    every = F.array_distinct(F.concat(*[F.coalesce(F.col(c), none) for c in columns]))
    met = df.select(key, F.explode(every).alias("form")).join(table, "form").groupBy(key).agg(
        F.collect_list(F.struct("form", "lemma")).alias("_met"))
    out = df.join(met, key, "left")
    listed = out.withColumns({c: F.coalesce(F.col(c), none) for c in columns})
    return listed.mapInArrow(met_lemmas(columns), listed.drop("_met").schema)


def _with_lists(batch: pa.RecordBatch, columns: list[str], lemmas_of) -> pa.RecordBatch:
    """A batch where each token of row ``i`` is replaced by its entry in
    ``lemmas_of[i]``."""
    names = [n for n in batch.schema.names if n != "_met"]

    def put(name: str) -> pa.Array:
        lists = batch.column(name)
        if name not in columns:
            return lists
        return pa.array([[at.get(t, t) for t in own] for own, at in
                         zip(lists.to_pylist(), lemmas_of)], lists.type)

    return pa.RecordBatch.from_arrays([put(n) for n in names], names)


def held_lemmas(held, columns: list[str]) -> Callable:
    """Batches with the lemmas of a broadcast ``(forms, lemmas)``."""
    def run(batches):
        at = dict(zip(*held.value, strict=True))
        for batch in batches:
            yield _with_lists(batch, columns, repeat(at))

    return run


def lemmatize_joined(df: DataFrame, columns: list[str], lemmas: DataFrame | LemmaGuesser,
                     max_held_rows: int = HELD_LEMMAS) -> DataFrame | None:
    """:func:`lemmatize_columns` of columns of joined tokens, by a guesser that the
    workers can hold; None for other lemmas."""
    model = lemmas.held(max_held_rows) if isinstance(lemmas, LemmaGuesser) else None
    if model is None:
        return None
    ship_package(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(guessed_lemmas(held, columns), df.schema)


def guessed_lemmas(held, columns: list[str]) -> Callable:
    """Batches with the lemmas of a broadcast guesser, asked once for each distinct
    token of a batch's column: lists of tokens, or tokens joined by a space."""
    def of_lists(lists, model):
        tokens = lists.flatten().dictionary_encode()
        lemmas = pa.array([guess(t, *model) for t in tokens.dictionary.to_pylist()],
                          lists.type.value_type)
        starts = pc.subtract(lists.offsets, lists.offsets[0])
        return pa.ListArray.from_arrays(starts, lemmas.take(tokens.indices), type=lists.type)

    def of_texts(texts, model):
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        joined = pc.binary_join(of_lists(parts, model), " ")
        return pc.if_else(pc.equal(pc.fill_null(texts, ""), ""), "", joined).cast(texts.type)

    def run(batches):
        model = held.value
        for batch in batches:
            found = []
            for name in batch.schema.names:
                values = batch.column(name)
                if name in columns:
                    listed = pa.types.is_list(values.type)
                    values = (of_lists if listed else of_texts)(values, model)
                found.append(values)
            yield pa.RecordBatch.from_arrays(found, batch.schema.names)

    return run


def met_lemmas(columns: list[str]) -> Callable:
    """Batches with the lemmas that each row brings along as ``_met``."""
    def run(batches):
        for batch in batches:
            yield _with_lists(batch, columns, [
                {x["form"]: x["lemma"] for x in met or ()}
                for met in batch.column("_met").to_pylist()])

    return run


def lemmatize_tokens(df: DataFrame, key: str, tokens: str, lemmas: DataFrame | LemmaGuesser,
                     max_broadcast_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """:func:`lemmatize_columns` of one column."""
    return lemmatize_columns(df, key, [tokens], lemmas, max_broadcast_rows)


def lemma_table(vocabulary: DataFrame, lemmatizer: Callable[[str], str],
                column: str = "term") -> DataFrame:
    """Build a ``(form, lemma)`` table by running a Python lemmatiser hook
    over the distinct terms of ``vocabulary`` (Arrow batches, once per term)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            forms = pdf[column].astype(str)
            yield pd.DataFrame({"form": forms, "lemma": [lemmatizer(f) for f in forms]})

    ship_package(vocabulary.sparkSession)
    distinct = vocabulary.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    schema = T.StructType([T.StructField("form", T.StringType()),
                           T.StructField("lemma", T.StringType())])
    return distinct.mapInPandas(run, schema)


def prepare_documents(raw: DataFrame, analyzer: Analyzer = DEFAULT_ANALYZER,
                      key: str = "doc_id") -> DataFrame:
    """Prepared corpus: key, id (= url), date, url, cleaned title / summary /
    text, and the analysed ``*_processed`` strings (tokens joined by a space).

    Each field is cleaned once; the analysis tokenises the cleaned column (a
    second projection, which Spark keeps separate because the cleaned value
    is used twice) instead of cleaning the raw text a second time. All fields
    of a document have one language: its ``lang`` if there is such a column
    and the analyzer knows it, else that of its body's tokens.
    """
    lang = F.col("lang") if "lang" in raw.columns else F.lit(None).cast("string")
    cleaned = raw.select(
        F.col(key), lang.alias("_lang"),
        as_text("url").alias("id"),
        as_text("date").alias("date"),
        as_text("url").alias("url"),
        basic_clean("title").alias("title"),
        basic_clean("summary").alias("summary"),
        basic_clean("text").alias("text"),
    )
    own = cleaned.withColumn("_lang", analyzer.language(tokenize("text"), "_lang"))
    fields = ("title", "summary", "text")
    return own.select(
        *[c for c in cleaned.columns if c != "_lang"],
        *[join_tokens(drop_stopwords(tokenize(c), "_lang", analyzer.stopwords))
          .alias(f"{c}_processed") for c in fields])


def query_terms(queries: DataFrame, analyzer: Analyzer = DEFAULT_ANALYZER,
                lemmas: DataFrame | LemmaGuesser | None = None) -> DataFrame:
    """``(query_id, term, qtf)``: analysed query terms with their repeat count
    (a term given twice counts twice). ``query_id`` is unique per query; a
    column ``lang`` gives the languages of the queries.

    Every query's terms are one row, so they are counted inside the row
    (distinct terms, then occurrences of each): no shuffle.
    """
    lang = "lang" if "lang" in queries.columns else None
    toks = queries.select("query_id", analyzer.query_tokens("query", lang).alias("terms"))
    if lemmas is not None:
        toks = lemmatize_tokens(toks, "query_id", "terms", lemmas)
    terms = F.col("terms")
    counted = F.transform(
        F.array_distinct(terms),
        lambda t: F.struct(t.alias("term"),
                           F.size(F.filter(terms, lambda x: x == t)).cast("long").alias("qtf")))
    return (toks.select("query_id", F.explode(counted).alias("p"))
            .select("query_id", "p.term", "p.qtf"))
