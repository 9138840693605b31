"""Operator 10: quality rules as a threshold table compiled into a projection.

``THRESHOLDS`` names a ratio and the range in which a text passes; the table
(a parameter) is compiled into one Spark projection. All measures are built-in
array and string functions, so the rules run as a map over the rows, without
user functions, shuffles or aggregation, and a hot source or a large group of
copies costs what its rows cost.

Words are runs of other characters than space and U+0009..U+000D. Windows of
eight words are told apart by 64-bit hashes within one text.

Defined results: null or empty text has no words and fails the base rule;
ratios over no words or lines are 0; very long texts are measured whole;
repeated rows get equal results; other columns stay, and one that has an
output's name is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cleared, columns, documents, whole_text

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "auf das dem den der die ein eine für im ist mit nicht sich sie und von zu "
    "al como con del el ella es esta la las lo los no para por se su una y"
).split()


class Threshold(NamedTuple):
    """A text passes if ``low`` <= ``measure`` <= ``high`` (None: open)."""

    measure: str
    low: float | None
    high: float | None


THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 15.0),
    Threshold("symbol_ratio", None, 0.3),
    Threshold("shout_ratio", None, 0.6),
    Threshold("stop_ratio", 0.02, None),
    Threshold("dup_line_ratio", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "mean_word_chars", "symbol_ratio", "shout_ratio", "stop_ratio", "dup_line_ratio",
            "base_failed", "kept")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pairs(items: Column, apart: int) -> Column:
    """Hash of every item and the one ``apart`` places on."""
    n = F.size(items) - apart
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(1 + apart), n),
                      lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column) -> Column:
    """Hash of each window of eight words (needs eight words at least)."""
    single = F.transform(words, lambda w: F.xxhash64(w))
    return let(single, lambda h: let(pairs(h, 1), lambda p: let(
        pairs(p, 2), lambda q: pairs(q, 4))))


def covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash is there twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s) - 1
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        before = F.concat(none, F.slice(s, F.lit(1), n))
        after = F.concat(F.slice(s, F.lit(2), n), none)
        # An item twice: once if it equals the one before, once if the one after.
        left = F.zip_with(s, before, lambda x, y: F.when(x["h"] == y["h"], x["i"]))
        right = F.zip_with(s, after, lambda x, y: F.when(x["h"] == y["h"], x["i"]))
        return F.sort_array(F.filter(
            F.zip_with(left, right, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))

    def cover(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda x, y: F.least(
            F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(placed, lambda s: let(repeated(s), cover))


def n_repeat_words(words: Column) -> Column:
    found = let(window_hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered_words(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, found).otherwise(0).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def compiled(thresholds: tuple[Threshold, ...]) -> Column:
    """The table as one boolean expression."""
    passes = F.lit(True)
    for t in thresholds:
        if t.low is not None:
            passes = passes & (F.col(t.measure) >= F.lit(float(t.low)))
        if t.high is not None:
            passes = passes & (F.col(t.measure) <= F.lit(float(t.high)))
    return passes


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def apply_rules(df: DataFrame, text: str = "text",
                thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """``df`` with all measures, ``base_failed`` and ``kept``."""
    df = cleared(df, [*MEASURES, "_words", "_lines", "_text", "_capitals", "_stops"], [text])
    t = F.col("_text")
    trimmed = F.btrim(t, F.lit(BLANKS))
    measured = df.withColumn("_text", whole_text(text)).select(
        "*",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
            F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"),
        F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"))
    bare = F.char_length(without(t, BLANKS))
    measured = measured.select(
        *columns(df),
        F.size("_words").cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.char_length(t) - F.char_length(without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
        .cast("long").alias("_capitals"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("_stops"))
    rated = measured.select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        ratio(F.col("_capitals"), F.col("word_chars")).alias("shout_ratio"),
        ratio(F.col("_stops"), F.col("n_words")).alias("stop_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .alias("base_failed")).drop("_capitals", "_stops")
    return rated.withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document measured and judged by the default table."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT k, unnest(generate_series(1, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT k, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM p),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS rep FROM (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM r) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)),
  lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, len(ws) AS n_words,
  len(array_to_string(ws, '')) AS word_chars,
  len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS caps,
  len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops
  FROM d JOIN w USING (k) JOIN l USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0
  AND n_symbols / n_words <= 0.3 AND caps / word_chars <= 0.6 AND stops / n_words >= 0.02
  AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5 AS kept
FROM b
"""
