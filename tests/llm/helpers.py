"""Small tables for the operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = ["alpha", "bé", "gamma", "delta", "xx", "the", "of", "z" * 30, "Ünder", "don't", "42"]


def texts(seed: int, n: int = 60) -> list[str]:
    """Texts with shared passages, copies, repeats and odd characters."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        t, u = rng.choice(base), rng.choice(base)
        k = rng.randint(0, len(t))
        out.append(t[:k] + rng.choice(["", u, "Q.\n", " 😀 "]) + t[k:])
    return out


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows and ids."""
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z", "en", "a", 5),
            (3, "one two three four five", "en", "a", 23), (3, "one two three four five", "en", "a", 23),
            (4, "one two three four five", "de", None, 23), (4, "other words", "de", "b", 11),
            (5, "word " * 30_000, "en", "a", 150_000), (6, " \n\t ", "en", "b", 4)]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    """``df`` with columns that have outputs' names, and an odd one."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("taken").alias(n) for n in names], F.lit(7).alias("a.b"))
