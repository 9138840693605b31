"""Operator 5: secret scans by rules and character Markov models.

Three patterns find the base spans (assigned values, access keys, hex keys).
For other strings, two first-order Markov models over characters, one of
random strings and one of ordinary identifiers, are compared by the mean log
likelihood ratio per character; strings above ``THRESHOLD`` are spans of kind
``random`` unless base spans cover them whole.

Training. The models are trained from labelled strings (string, label, weight, n).
``labelled_samples`` makes them from the corpus itself: ordinary identifiers
are the words, and pairs of words joined by ``_``, ``-``, ``/`` or nothing, of
all documents, numbers, and runs of one character; random strings are base64
and hex digests, in lower and upper case. Words of a corpus of more than ``PER_DOCS`` documents weigh
less, as if that many had been counted, so that the numbers, the runs and the
smoothing keep their weight at any size. Character pairs are counted by Spark;
only the table of pair counts (65 x 65 x 3 at most) reaches the driver, and its
ratios go back as a literal array.

Everything on the rows is built-in functions. Spans are code point offsets;
they follow from the lengths of the pieces between matches.

Defined results: null or empty text has no spans; very long texts and runs are
scanned whole; repeated rows get equal results; without any samples the models
are uniform and add no span; an empty table gives an empty table; other
columns stay, and one that has an output's name is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cleared, documents, whole_text
from quarry.llm.rules import let

# The base patterns and least lengths of the contract.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 1.5        # mean log ratio per character pair
PER_DOCS = 400         # documents that the counts of ordinary words are scaled to
SAMPLE_RANDOM = 4000   # digests that give random strings and numbers
SPAN = "struct<start:int,kind:int,end:int>"
MARK = "[SECRET]"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans(text: Column, pattern: str, kind: int, matches: Column) -> Column:
    """Spans of ``matches`` (all matches of ``pattern``), from the gaps between them."""
    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(gaps, found, lambda g, m: F.struct(
            F.char_length(g).alias("gap"), F.char_length(m).alias("size")))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"),
                            (start + x["size"]).alias("end"))
            return F.struct((start + x["size"]).alias("at"),
                            F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none().alias("spans")), step,
                           lambda acc: acc["spans"])

    return F.when(F.size(matches) > 0, let(matches, placed)).otherwise(none())


def pair_codes(string: Column) -> Column:
    """Each pair of neighbours as one number (characters outside count as none)."""
    codes = F.transform(F.split(string, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    width = len(ALPHABET) + 1
    return let(codes, lambda k: F.zip_with(
        F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1),
        lambda a, b: a * width + b))


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(string, label, weight, n): 1 for random strings, 0 for ordinary identifiers.

    A word and its pair with the next one are given as parts that have the same
    pairs of characters, ``n`` times each: the word, the junction, the second
    word. So only distinct words with the initial of the next one are counted.
    """
    spark = docs.sparkSession
    weight = min(1.0, PER_DOCS / max(1, docs.count()))
    # The outer form, as the other has the words extracted twice (inferred filter).
    placed = docs.select(F.regexp_extract_all(
        whole_text(text), F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("w")).select(
        "w", F.posexplode_outer("w").alias("at", "word"))
    # The last word is joined to itself: how often a word is the second one.
    second = (F.col("at") > 0).cast("int") + (F.col("at") == F.size("w") - 1).cast("int")
    initial = F.upper(F.left(F.coalesce(F.get("w", F.col("at") + 1), "word"), F.lit(1)))
    counted = placed.where("word IS NOT NULL").groupBy(
        "word", initial.alias("initial"), second.alias("second")).agg(
        F.count(F.lit(1)).alias("n"))
    separator = F.element_at(F.split(F.lit("_ - / "), " "), F.length("word") % 4 + 1)

    def part(string: Column, times: Column) -> Column:
        return F.struct(string.alias("string"), (F.col("n") * times).alias("n"))

    ordinary = counted.select(F.explode(F.array(
        part(F.col("word"), F.lit(2)),
        part(F.concat(F.right("word", F.lit(1)), separator, "initial"), F.lit(1)),
        part(F.initcap("word"), F.col("second")))).alias("p")).select("p.string", "p.n")
    digest = F.sha2(F.col("id").cast("string"), 256)
    drawn = spark.range(SAMPLE_RANDOM)
    numbers = drawn.select(F.translate(F.substr(digest, F.lit(1), F.lit(24)), "abcdef", "012345"))
    runs = drawn.select(F.repeat(F.substr(
        F.lit(ALPHABET), F.pmod("id", F.lit(len(ALPHABET))) + 1, F.lit(1)), F.lit(24)))
    coded = F.base64(F.unhex(digest))
    random = drawn.select(coded).union(drawn.select(F.translate(coded, "+/", "-_"))).union(
        drawn.select(digest)).union(drawn.select(F.upper(digest)))
    made = numbers.union(runs).withColumn("label", F.lit(0)).union(
        random.withColumn("label", F.lit(1)))
    return ordinary.select("string", F.lit(0).alias("label"), F.lit(weight).alias("weight"), "n").union(
        made.select("*", F.lit(1.0), F.lit(1)))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of each character pair: random strings against identifiers.

    ``samples`` has ``string``, ``label`` and, unless they are 1, ``weight`` and
    the count ``n``."""
    width = len(ALPHABET) + 1
    weight, n = (F.col(c) if c in samples.columns else F.lit(1).alias(c) for c in ("weight", "n"))
    counted = (samples.where("length(string) > 1")
               .select("label", weight, n, F.explode(pair_codes(F.col("string"))).alias("pair"))
               .groupBy("label", "weight", "pair").agg(F.sum("n")).collect())
    counts = [[0.0] * width * width for _ in range(2)]
    for label, weight, pair, n in sorted(counted):
        counts[label][pair] += weight * n

    def logs(table: list[float]) -> list[float]:
        totals = [sum(table[a * width:(a + 1) * width]) for a in range(width)]
        return [math.log((n + 1) / (totals[i // width] + width)) for i, n in enumerate(table)]

    return [r - o for r, o in zip(logs(counts[1]), logs(counts[0]), strict=True)]


def score(string: Column, model: list[float]) -> Column:
    """Mean log likelihood ratio per pair of characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return let(pair_codes(string), lambda p: F.aggregate(
        p, F.lit(0.0), lambda acc, x: acc + F.element_at(table, x + 1)) / F.size(p))


def random_spans(text: Column, base: Column, candidates: Column, model: list[float]) -> Column:
    """Spans of candidates that score high and aren't covered by (sorted) base spans."""
    def covered(s: Column) -> Column:
        reached = F.aggregate(base, s["start"], lambda at, b: F.when(
            b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
        return reached >= s["end"]

    def chosen(found: Column) -> Column:
        scored = F.transform(found, lambda c: score(c, model))
        placed = F.zip_with(spans(text, CANDIDATE, 3, found), scored,
                            lambda s, x: F.when(x > THRESHOLD, s))
        return F.filter(placed, lambda s: s.isNotNull() & ~covered(s))

    return F.when(F.size(candidates) > 0, let(candidates, chosen)).otherwise(none())


def scan(df: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``secrets``: sorted arrays of (start, kind, end)."""
    work = {f"_{n}": n for n in ("t", "assign", "values", "access", "hex", "candidates")}
    df = cleared(df, ["base", "secrets", *work], [text])
    t = F.col("_t")

    def every(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))

    found = df.withColumn("_t", whole_text(text)).select(
        "*", every(ASSIGN).alias("_assign"), every(ACCESS).alias("_access"),
        every(HEX).alias("_hex"), every(CANDIDATE).alias("_candidates"))
    assigned = F.when(F.size("_assign") > 0, F.filter(
        F.zip_with(spans(t, ASSIGN, 0, F.col("_assign")), every(ASSIGN, 2), lambda s, v: F.when(
            F.char_length(v) >= MIN_ASSIGNED, s)), lambda s: s.isNotNull())).otherwise(none())
    based = found.withColumn("base", F.sort_array(F.concat(
        assigned, spans(t, ACCESS, 1, F.col("_access")), spans(t, HEX, 2, F.col("_hex")))))
    return based.withColumn("secrets", F.sort_array(F.concat(
        "base", random_spans(t, F.col("base"), F.col("_candidates"), model)))).drop(*work)


def listed(found: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every run of overlapping spans as one mark."""
    def step(acc: Column, s: Column) -> Column:
        more = s["start"] >= acc["at"]
        out = F.when(more, F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MARK))
        ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    # Spans that overlap the one before add to its end but no mark.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))).otherwise(text)


def redact(df: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """``df`` with each secret in ``text`` replaced by a mark."""
    return scan(df, model, text).withColumn(
        text, redacted(whole_text(text), F.col("secrets"))).drop("base", "secrets")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(labelled_samples(docs))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs, model).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("secrets").alias("spans"))
