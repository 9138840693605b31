from pyspark.sql import functions as F

from quarry.functions.text import (CLEAN_PATTERN, QUICK_CLEAN_PATTERN, QUICK_SPACE_PATTERN,
                                   SPACE_RUN_PATTERN, basic_clean, snippet, split_tokens,
                                   tokenize)
from quarry.operators.analyze import Analyzer, lemma_table, lemmatize_tokens, query_terms


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_document_analyzer_keeps_punctuation_and_digits(spark):
    a = Analyzer(lists=())
    assert one(spark, a.document_tokens("x"), "Рост 2020!") == ["рост", "2020", "!"]


def test_query_analyzer_drops_tokens_without_letters(spark):
    a = Analyzer(lists=())
    assert one(spark, a.query_tokens("x"), "Рост 2020!") == ["рост"]


def test_document_clean_vs_query_no_clean(spark):
    a = Analyzer(lists=())
    assert one(spark, basic_clean("x"), "a@b#c") == "a b c"
    assert one(spark, a.document_tokens("x"), "a@b#c") == ["a", "b", "c"]
    assert one(spark, a.query_tokens("x"), "a@b#c") == ["a", "b", "c"]


def test_stop_words_after_lower_case(spark):
    a = Analyzer(lists=(("en", ("the",)),))
    assert one(spark, a.document_tokens("x"), "The cat") == ["cat"]
    assert one(spark, a.query_tokens("x"), "The cat") == ["cat"]


def test_null_gives_empty(spark):
    a = Analyzer()
    assert one(spark, a.document_tokens("x"), None) == []
    assert one(spark, a.query_tokens("x"), None) == []
    assert one(spark, basic_clean("x"), None) == ""


def test_basic_clean_whitespace_and_kept_punctuation(spark):
    text = "  «Hello», world  -- it's   ok?!  "
    assert one(spark, basic_clean("x"), text) == "«Hello», world -- it's ok?!"


def test_tokens_join_hyphen_apostrophe_dot(spark):
    assert one(spark, tokenize("x"), "e-mail don't 3.14 end.") == [
        "e-mail", "don't", "3.14", "end", "."]


def test_split_tokens_empty(spark):
    assert one(spark, split_tokens("x"), "") == []
    assert one(spark, split_tokens("x"), "a b") == ["a", "b"]


def test_snippet(spark):
    assert one(spark, snippet("x", 3), "abcdef") == "abc..."


def test_repeated_query_terms_count(spark):
    q = spark.createDataFrame([(1, "e e f")], "query_id long, query string")
    rows = {r["term"]: r["qtf"] for r in query_terms(q, Analyzer(lists=())).collect()}
    assert rows == {"e": 2, "f": 1}


def test_lemmas_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(1, ["cats", "dog", "cats"]), (2, [])],
                               "doc_id long, terms array<string>")
    lemmas = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    out = {r["doc_id"]: r["terms"] for r in
           lemmatize_tokens(df, "doc_id", "terms", lemmas).collect()}
    assert out == {1: ["cat", "dog", "cat"], 2: []}


def test_lemma_hook_runs_on_distinct_terms(spark):
    vocab = spark.createDataFrame([("Cats",), ("Cats",), ("dog",)], "term string")
    table = {r["form"]: r["lemma"] for r in lemma_table(vocab, str.lower).collect()}
    assert table == {"Cats": "cats", "dog": "dog"}


def test_stop_word_filter_stays_in_jvm(spark):
    df = spark.createDataFrame([("a the b",)], "x string")
    plan = df.select(Analyzer(lists=(("en", tuple("qwertyuiopasdf") + ("the",)),))
                     .document_tokens("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper()


def test_stop_words_of_the_rows_language(spark):
    rows = [(1, "the war of the hat", "en"), (2, "der Krieg war hat", "de"), (3, "war", None),
            (4, "the son of a hat maker", None), (5, "der hat war", None), (6, "", None),
            (7, "the war", "xx"), (8, "die Katze und the dog", None)]
    df = spark.createDataFrame(rows, "id long, x string, lang string")
    got = {r["id"]: r["t"] for r in df.select(
        "id", Analyzer().document_tokens("x", "lang").alias("t")).collect()}
    assert got == {1: ["war", "hat"], 2: ["krieg"], 3: ["war"], 4: ["son", "hat", "maker"],
                   5: ["der", "hat", "war"], 6: [], 7: ["war"], 8: ["katze", "the", "dog"]}


def test_query_language(spark):
    q = spark.createDataFrame([(1, "war"), (2, "the son of a hat maker"), (3, None)],
                              "query_id long, query string")
    got = sorted((r["query_id"], r["term"]) for r in query_terms(q).collect())
    assert got == [(1, "war"), (2, "hat"), (2, "maker"), (2, "son")]
    given = spark.createDataFrame([(1, "war the", "de")], "query_id long, query string, lang string")
    assert [r["term"] for r in query_terms(given).collect()] == ["the"]


def test_quick_space_pattern_equals_the_plain_one(spark):
    chars = [chr(c) for c in range(0x3100) if c not in (0xD800,)]
    texts = [f"a{c}b {c} c{c}{c}{c} " for c in chars] + ["a  b", " \t a \u2003\n", "a b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    quick = F.regexp_replace("t", QUICK_SPACE_PATTERN, " ")
    assert df.where(quick != F.regexp_replace("t", SPACE_RUN_PATTERN, " ")).count() == 0


def test_quick_clean_pattern_equals_the_plain_one(spark):
    chars = (chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    df = spark.createDataFrame([(f"a{c}b{c}{c} {c}.",) for c in chars], "t string")
    quick = F.regexp_replace("t", QUICK_CLEAN_PATTERN, "#")
    assert df.where(quick != F.regexp_replace("t", CLEAN_PATTERN, "#")).count() == 0
