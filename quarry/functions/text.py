"""Column expressions for cleaning and tokenising text.

Every function here returns a ``pyspark.sql.Column`` built from built-in
functions, so the work stays in the JVM next to the scan. The patterns are
written so that Java's regex engine (Spark) and RE2 (the DuckDB oracle) read
them alike: Unicode classes are spelled ``\\p{L}`` / ``\\p{N}`` and the
non-ASCII whitespace characters are literal characters, not escapes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace that Python's ``\s`` matches beyond ASCII: U+000B, U+001C-U+001F,
# U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
EXTRA_WHITESPACE = (
    "\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Characters kept by the basic clean besides letters, digits, "_" and spaces.
KEPT_PUNCTUATION = ".,!?\\-'«»"
# Numbers with inner commas or points; word tokens, optionally joined by - ' or . ;
# an ellipsis; else a single punctuation mark.
TOKEN_PATTERN = (r"\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:[-'.][\p{L}\p{N}_]+)*"
                 r"|\.\.\.|[.,!?«»'-]")
LETTER_PATTERN = r"\p{L}"
# --- end of fixed values ----------------------------------------------------

WHITESPACE_CLASS = r"\s" + EXTRA_WHITESPACE
CLEAN_PATTERN = r"[^\p{L}\p{N}_" + WHITESPACE_CLASS + KEPT_PUNCTUATION + "]+"
# What Spark runs: the same characters, nested so that Java tests a letter first, not
# after going down through every part of the class.
QUICK_CLEAN_PATTERN = (r"[^\p{L}[\p{N}_ " + KEPT_PUNCTUATION + "[" + WHITESPACE_CLASS + "]]]+")
SPACE_RUN_PATTERN = "[" + WHITESPACE_CLASS + "]+"
# What Spark runs: the same runs without those that are one space already. ASCII is
# told apart first, as Java would test it against every part of the class.
QUICK_SPACE_PATTERN = (rf" [[^!-~]&&[{WHITESPACE_CLASS}]]+"
                       rf"|[[^ -~]&&[{WHITESPACE_CLASS}]][[^!-~]&&[{WHITESPACE_CLASS}]]*")

# Rank keys: scores are compared on a 1e-9 grid so that two engines that sum
# in a different order still agree on ties.
RANK_SCALE = 1e9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """Null guard for typed string columns: null becomes ``""``."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def basic_clean(c) -> Column:
    """Drop everything but word characters, whitespace and ``. , ! ? - ' « »``;
    collapse whitespace runs into one space; strip."""
    cleaned = F.regexp_replace(as_text(c), QUICK_CLEAN_PATTERN, " ")
    collapsed = F.regexp_replace(cleaned, QUICK_SPACE_PATTERN, " ")
    return F.trim(collapsed)


def tokenize(c) -> Column:
    """Lower-case, then extract word and punctuation tokens (array<string>)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), 0)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def member(t: Column, words: Iterable[str], few: bool) -> Column:
    """Whether ``t`` is one of ``words``: a hash set, quick on many rows, or for
    ``few`` rows a list that is one literal, quick to plan."""
    return F.array_contains(F.split(F.lit(" ".join(words)), " "), t) if few else t.isin(*words)


def drop_stopwords(tokens, lang, by_language: Mapping[str, Iterable[str]],
                   few: bool = False) -> Column:
    """Remove the stop words of each row's language ``lang``, keeping order and
    repeats (not ``array_except``). A language without a list drops nothing."""
    def without(own: Column, words: Iterable[str]) -> Column:
        return F.filter(own, lambda t: ~member(t, words, few))

    def kept(code: Column, own: Column) -> Column:
        left = own   # the language is looked up once a row, not once a token
        for each, words in by_language.items():
            left = F.when(code == each, without(own, words)).otherwise(left)
        return left

    return bind(_col(lang), lambda code: bind(_col(tokens), lambda own: kept(code, own)))


def stop_language(tokens, by_language: Mapping[str, Iterable[str]], few: bool = False) -> Column:
    """The language whose list holds most of the tokens (of equals the first).

    Null if no list holds any, or if no token with a letter would be left: a
    lone "war" may be a German stop word, but it's all there is.
    """
    def hits(own: Column, words: Iterable[str]) -> Column:
        return F.size(F.filter(own, lambda t: member(t, words, few)))

    def code_of(counts: Column) -> Column:
        codes = F.array(*[F.lit(code) for code in by_language]).cast("array<string>")
        best = F.element_at(codes, F.array_position(counts, F.array_max(counts)).cast("int"))
        return F.when(F.array_max(counts) > 0, best)

    def kept(own: Column, code: Column) -> Column:
        left = keep_letter_tokens(drop_stopwords(own, code, by_language, few))
        return F.when(F.size(left) > 0, code)

    def decide(own: Column) -> Column:
        counts = F.array(*[hits(own, words) for words in by_language.values()]).cast("array<int>")
        return bind(bind(counts, code_of), lambda code: kept(own, code))

    return bind(_col(tokens), decide)


def keep_letter_tokens(tokens) -> Column:
    """Keep tokens that contain at least one letter."""
    return F.filter(_col(tokens), lambda t: t.rlike(LETTER_PATTERN))


def join_tokens(tokens) -> Column:
    return F.array_join(_col(tokens), " ")


def split_tokens(c) -> Column:
    """Inverse of :func:`join_tokens`; an empty string gives an empty array."""
    return F.filter(F.split(as_text(c), " "), lambda t: t != "")


def snippet(c, n: int) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(as_text(c), 1, n), F.lit("..."))


def rank_key(score) -> Column:
    """Integer sort key of a score on a 1e-9 grid."""
    return F.floor(_col(score) * F.lit(RANK_SCALE) + F.lit(0.5))
