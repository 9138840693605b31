"""Lemmas of unseen forms, guessed from the endings of known ones.

Training. A pair (form, lemma) is a rule: how many characters to cut from the
form and what to add. Every ending of the form that holds the characters to be
cut, up to ``LONGEST`` characters, is a node of a trie of reversed forms and
gets one vote for the rule. A node keeps the rule with most votes (then the
least cut, then the first addition) where it has ``MIN_VOTES`` forms at least.
The trie is a table ``endings(ending, cut, addition, votes, forms)``: a path
from its root is an ending, so the deepest node that a term reaches is the
longest known ending.

Use. Terms that the pairs know take their lemma (of several, the most frequent,
then the first). Others take the rule of their longest known ending, which must
leave a character of the term. Terms without a known ending, or without a
letter, stay as they are.

``table_for`` runs over the *distinct* terms of a corpus as joins and aggregates:
six candidate rows per term at most, and the table of endings is broadcast
where its count is within bounds. ``held`` gives both tables as hash tables, so
that the tokens of a row get their lemmas where they are: the distinct terms of a
corpus grow with it, the guesser's tables don't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import LETTER_PATTERN
from quarry.session import bounded_broadcast, scratch_path, write_parquet

LONGEST = 6     # characters of an ending
MIN_VOTES = 2   # forms of a node


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of characters that two strings begin with alike."""
    n = F.least(F.char_length(a), F.char_length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.left(a, i) == F.left(b, i)))


def rules(pairs: DataFrame) -> DataFrame:
    """``(form, lemma, cut, addition)`` of the distinct pairs."""
    known = pairs.select("form", "lemma").where(
        F.col("form").isNotNull() & F.col("lemma").isNotNull()).distinct()
    same = known.withColumn("_same", shared_prefix(F.col("form"), F.col("lemma")))
    return same.select("form", "lemma", (F.char_length("form") - F.col("_same")).alias("cut"),
                       F.substr("lemma", F.col("_same") + 1).alias("addition"))


def endings(pairs: DataFrame, longest: int = LONGEST, min_votes: int = MIN_VOTES) -> DataFrame:
    """``(ending, cut, addition, votes, forms)``: the nodes of the trie."""
    least = F.greatest(F.col("cut"), F.lit(1))
    most = F.least(F.lit(longest), F.char_length("form") - 1)
    each = rules(pairs).where(least <= most).select(
        "cut", "addition", F.col("form"), F.explode(F.sequence(least, most)).alias("_n"))
    votes = each.groupBy(F.right("form", "_n").alias("ending"), "cut", "addition").agg(
        F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("fewer"), "cut", "addition"))
    return votes.groupBy("ending").agg(best.alias("b"), F.sum("votes").alias("forms")).where(
        F.col("forms") >= min_votes).select(
        "ending", "b.cut", "b.addition", (-F.col("b.fewer")).alias("votes"), "forms")


def known_lemmas(pairs: DataFrame) -> DataFrame:
    """``(form, lemma)``: one lemma per known form."""
    counted = pairs.where(F.col("form").isNotNull() & F.col("lemma").isNotNull()).groupBy(
        "form", "lemma").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("form").agg(
        F.min(F.struct((-F.col("n")).alias("fewer"), "lemma")).alias("b")).select("form", "b.lemma")


def guess(form: str, known: dict[str, str], nodes: dict[str, tuple[int, str]],
          longest: int) -> str:
    """The lemma that ``table_for`` gives a form, from tables of ``held``."""
    if form in known:
        return known[form]
    for n in range(min(longest, len(form) - 1), 0, -1):
        if form[-n:] in nodes:
            cut, addition = nodes[form[-n:]]
            return form[:len(form) - cut] + addition
    return form


@dataclass
class LemmaGuesser:
    """Known lemmas and the trie of endings, for terms seen or not."""

    known: DataFrame
    nodes: DataFrame
    longest: int = LONGEST

    @classmethod
    def fit(cls, pairs: DataFrame, longest: int = LONGEST,
            min_votes: int = MIN_VOTES) -> "LemmaGuesser":
        """Both tables written once under the checkpoint directory."""
        path = scratch_path(pairs.sparkSession, "lemmas")
        return cls(write_parquet(known_lemmas(pairs), f"{path}/known"),
                   write_parquet(endings(pairs, longest, min_votes), f"{path}/endings"), longest)

    def semanticHash(self) -> int:   # noqa: N802 - as of a DataFrame, for the engine cache
        return hash((self.known.semanticHash(), self.nodes.semanticHash(), self.longest))

    def held(self, max_rows: int) -> tuple[dict, dict, int] | None:
        """``known``, ``nodes`` and ``longest`` of :func:`guess`, or None above
        ``max_rows`` rows, or where an ending has no letter (a term that ends in
        one with a letter needs no further test for letters)."""
        if self.known.count() + self.nodes.count() > max_rows:
            return None
        forms, lemmas = (c.to_pylist() for c in self.known.select("form", "lemma").toArrow())
        ending, cut, addition, lettered = (c.to_pylist() for c in self.nodes.select(
            "ending", "cut", "addition", F.col("ending").rlike(LETTER_PATTERN)).toArrow())
        if not all(lettered):
            return None
        return (dict(zip(forms, lemmas, strict=True)),
                dict(zip(ending, zip(cut, addition, strict=True), strict=True)), self.longest)

    def table_for(self, terms: DataFrame, column: str = "term") -> DataFrame:
        """``(form, lemma, source)`` of the distinct terms; ``source`` is
        ``known``, ``guessed`` or ``kept``."""
        forms = terms.select(F.col(column).alias("form")).where(
            F.col("form").isNotNull()).distinct()
        known, _, _ = bounded_broadcast(self.known)
        nodes, _, _ = bounded_broadcast(self.nodes)
        met = forms.join(known, "form", "left")
        most = F.least(F.lit(self.longest), F.char_length("form") - 1)
        open_ = F.col("lemma").isNull() & F.col("form").rlike(LETTER_PATTERN) & (most >= 1)
        sizes = F.when(open_, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(
            F.array(F.lit(0)))   # one row without a candidate
        each = met.select("form", "lemma", F.explode(sizes).alias("_n")).withColumn(
            "ending", F.when(F.col("_n") > 0, F.right("form", "_n")))
        found = each.join(nodes, "ending", "left")
        best = found.groupBy("form").agg(
            F.max("lemma").alias("lemma"),
            F.max(F.when(F.col("cut").isNotNull(), F.struct("_n", "cut", "addition"))).alias("b"))
        guess = F.concat(F.left("form", F.char_length("form") - F.col("b.cut")),
                         F.col("b.addition"))
        return best.select(
            "form", F.coalesce("lemma", guess, "form").alias("lemma"),
            F.when(F.col("lemma").isNotNull(), "known").when(F.col("b").isNotNull(), "guessed")
            .otherwise("kept").alias("source"))
