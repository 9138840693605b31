from collections import Counter, defaultdict

import pytest

from quarry.functions import inflections
from quarry.functions.text import split_tokens
from quarry.operators.analyze import lemmatize_columns, lemmatize_joined, lemmatize_tokens
from quarry.operators.lemmas import LONGEST, MIN_VOTES, LemmaGuesser


def brute_endings(pairs):
    """{ending: (cut, addition, votes, forms)} by the definition."""
    votes = defaultdict(Counter)
    for form, lemma in set(pairs):
        same = 0
        while same < min(len(form), len(lemma)) and form[same] == lemma[same]:
            same += 1
        cut = len(form) - same
        for n in range(max(cut, 1), min(LONGEST, len(form) - 1) + 1):
            votes[form[-n:]][cut, lemma[same:]] += 1
    out = {}
    for ending, counted in votes.items():
        (cut, addition), n = min(counted.items(), key=lambda x: (-x[1], x[0]))
        if counted.total() >= MIN_VOTES:
            out[ending] = (cut, addition, n, counted.total())
    return out


def brute_lemma(nodes, known, term):
    if term in known:
        return known[term], "known"
    if any(c.isalpha() for c in term):
        for n in range(min(LONGEST, len(term) - 1), 0, -1):
            if term[-n:] in nodes:
                cut, addition, *_ = nodes[term[-n:]]
                return term[:len(term) - cut] + addition, "guessed"
    return term, "kept"


@pytest.fixture(scope="module")
def fitted(spark):
    train = inflections.pairs(0)
    return train, LemmaGuesser.fit(spark.createDataFrame(train, "form string, lemma string"))


def test_nodes_equal_the_definition(spark, fitted):
    train, guesser = fitted
    got = {r["ending"]: (r["cut"], r["addition"], r["votes"], r["forms"])
           for r in guesser.nodes.collect()}
    assert got == brute_endings(train)


def test_lemmas_equal_the_definition(spark, fitted):
    train, guesser = fitted
    terms = [f for f, _ in inflections.pairs()] + [
        "", "1", "42", "...", "a", "я", "xyzzy", "2020s", "ing", "unknowning", None, "walked"]
    got = {r["form"]: (r["lemma"], r["source"]) for r in guesser.table_for(
        spark.createDataFrame([(t,) for t in terms * 2], "term string")).collect()}
    nodes = brute_endings(train)
    known = {}
    for form, lemma in sorted(train, reverse=True):   # of several lemmas the first
        known[form] = lemma
    assert got == {t: brute_lemma(nodes, known, t) for t in terms if t is not None}


def held_out_accuracy(fold):
    train = inflections.pairs(fold)
    nodes, known = brute_endings(train), dict(train)
    tested = [(f, x) for f, x in inflections.pairs(fold, held_out=True) if f not in known]
    return sum(brute_lemma(nodes, known, f)[0] == x for f, x in tested) / len(tested)


def test_held_out_accuracy():
    assert sum(map(held_out_accuracy, range(4))) / 4 >= 0.8


def test_order_and_repeats_stay(spark, fitted):
    _, guesser = fitted
    rows = [(1, ["школами", "и", "школами", "42", "планетой"]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    got = {r["id"]: r["terms"] for r in lemmatize_tokens(df, "id", "terms", guesser).collect()}
    assert got == {1: ["школа", "и", "школа", "42", "планета"], 2: [], 3: []}


def test_held_guesser_equals_its_table(spark, fitted):
    """However many distinct tokens there are, no row moves for a small guesser."""
    _, guesser = fitted
    many = ["".join(chr(97 + i // 26 ** n % 26) for n in range(3)) + "ing" for i in range(3000)]
    odd = ["", "a", "42", "42ing", "ing", "я", "ﬁxing", "e\u0301s", "𝔘ing", "-ed", "школами", None]
    rows = [(1, [*many, *odd, *odd], None), (2, [], ["ing", None]), (3, None, odd), (4, odd, many[:9])]
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>")
    held = guesser.known.count() + guesser.nodes.count()
    out = lemmatize_columns(df, "id", ["x", "y"], guesser, max_held_rows=held)
    tabled = lemmatize_columns(df, "id", ["x", "y"], guesser, max_held_rows=held - 1)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (out, tabled)]
    assert held < len(many) and "Join" not in plans[0] and "Join" in plans[1]
    got = {r["id"]: r for r in out.collect()}
    assert got == {r["id"]: r for r in tabled.collect()} and len(got) == 4
    assert got[3]["x"] == [] and got[4]["y"] != many[:9]
    # Joined by spaces, as the corpus has them.
    texts = spark.createDataFrame([(i, " ".join(t for t in r["x"] if t)) for i, r in
                                   [(1, {"x": many + odd}), (2, {"x": []}), (3, {"x": ["ing"]})]],
                                  "id long, x string")
    joined = {r["id"]: r["x"] for r in lemmatize_joined(texts, ["x"], guesser).collect()}
    lists = texts.withColumn("x", split_tokens("x"))
    want = lemmatize_columns(lists, "id", ["x"], guesser, max_held_rows=0)
    assert joined == {r["id"]: " ".join(r["x"]) for r in want.collect()}
    assert lemmatize_joined(texts, ["x"], guesser, held - 1) is None


def test_endings_without_a_letter_are_not_held(spark):
    guesser = LemmaGuesser.fit(spark.createDataFrame(
        [("a12", "a"), ("b12", "b")], "form string, lemma string"))
    assert guesser.held(1000) is None
    df = spark.createDataFrame([(1, ["c12", "712"])], "id long, terms array<string>")
    assert lemmatize_tokens(df, "id", "terms", guesser).first()["terms"] == ["c", "712"]


def test_empty_training_table_keeps_all(spark):
    guesser = LemmaGuesser.fit(spark.createDataFrame([], "form string, lemma string"))
    got = guesser.table_for(spark.createDataFrame([("walked",)], "term string")).collect()
    assert [tuple(r) for r in got] == [("walked", "walked", "kept")]
    odd = LemmaGuesser.fit(spark.createDataFrame(
        [(None, "a"), ("b", None), ("went", "go"), ("went", "go"), ("went", "wend"), ("x", "")],
        "form string, lemma string"))
    found = {r["form"]: r["lemma"] for r in odd.table_for(
        spark.createDataFrame([("went",), ("x",), ("b",)], "term string")).collect()}
    assert found == {"went": "go", "x": "", "b": "b"}


def test_only_changed_forms_cross_the_shuffle(spark):
    rows = [(1, ["a", "b", "a", "c"], ["b"]), (2, [], None), (3, ["c", "c"], []), (4, ["b"], ["a"])]
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>")
    lemmas = spark.createDataFrame([("a", "z"), ("b", "b"), ("c", None)], "form string, lemma string")
    # Lemmas shuffled, broadcast, and held by the workers.
    for limit, held in ((0, 0), (1000, 0), (1000, 1000)):
        out = lemmatize_columns(df, "id", ["x", "y"], lemmas, limit, held)
        assert {r["id"]: (r["x"], r["y"]) for r in out.collect()} == {
            1: (["z", "b", "z", "c"], ["b"]), 2: ([], []), 3: (["c", "c"], []), 4: (["b"], ["z"])}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "array_sort" not in plan and ("array_distinct" in plan) == (held == 0)
