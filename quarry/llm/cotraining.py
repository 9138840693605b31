"""Operator 7: quality classifier by co-training of two views.

The text view sees a document's shape (lengths, symbols, capitals, repeats)
and which of a few hundred telling words it has; the metadata view sees its
source, language and size. Both are logistic regressions. In each round each
view labels every unlabelled document that it is sure of, for the other one to
learn from, beside the labels. At the end each view's score is calibrated on
held-out labels (Platt), and the calibrated log odds are added, less the
prior's. A document is good if its label has quality 1 and toxic 0.

The labelled rows used are bounded (parameter ``SAMPLE``, those with the least
id hash): their features, never texts, reach the driver, which fits some hundred
weights. All other documents are unlabelled ones. Their features are written
down once; a round is one pass over that table. A document's pseudo-label is
the first confident one of the other view through all rounds so far, worked out
anew from the views' history, so no state is kept by document. The tasks sum
the gradients and curvatures of the pseudo-labelled documents at the learning
view's weights, and the driver adds their second-order form to the labelled
rows' likelihood. Pseudo-labels of a class together weigh at most ``INFLUENCE``
of the labels' weight, so their number doesn't drown the labels.

Telling words are chosen by chi-square from word counts that Spark aggregates
over the labelled sample. The models are broadcast, and all documents are
scored in one pass without a shuffle.

Defined results: null or empty text has zero features and is scored like any
other; null source or language is a value of its own; null labels are left
out, and of several labels of a document the worst counts; without both good
and bad labels the score is 1 and everything is kept; repeated rows get equal
scores; an empty table gives an empty table; other columns stay, and one that
has an output's name is replaced by it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import (
    cleared, documents, least_hashed, map_batches, python_ready, staged, table, whole_text)

SAMPLE = 8000       # labelled rows used
WORDS = 256         # telling words
MIN_SUPPORT = 5     # documents of the sample that have a telling word
MIN_CHI = 15.0      # chi-square of a telling word at least (chance: 1 in 10,000)
ROUNDS = 3
CONFIDENT = 0.95
INFLUENCE = 0.4     # weight of a class's pseudo-labels against its labels, at most
PIECES = 16         # pieces in which the tasks' sums are added up
HELD_OUT = 0.25     # share of the labelled rows that calibrate
KEEP_FROM = 0.5

SOURCE_SLOTS, LANG_SLOTS = 64, 16
WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
SHAPES = 11


def shape(text: str) -> tuple[list[float], set[str]]:
    """Shape features of a text, and its words."""
    tokens = text.split()
    words = WORD.findall(text.lower())
    n, chars = len(tokens), len(text)
    known = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return [0.0] * SHAPES, known
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    return [
        math.log1p(n), chars / n, len(SYMBOL.findall(text)) / n,
        sum(map(str.isupper, tokens)) / n, text.count("!") / n,
        sum(map(str.isdigit, tokens)) / n, len(set(tokens)) / n, again / n,
        1 - len(set(lines)) / len(lines), math.log1p(chars / len(lines)),
        sum(map(text.count, ".,")) / n], known


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> list[tuple[int, float]]:
    """(feature, value) pairs of the metadata view."""
    def slot(value: str | None, slots: int) -> int:
        return 0 if value is None else 1 + zlib.crc32(value.encode("utf-8")) % (slots - 1)

    size = math.log1p(max(n_chars or 0, 0))
    return [(slot(source, SOURCE_SLOTS), 1.0), (SOURCE_SLOTS + slot(lang, LANG_SLOTS), 1.0),
            (SOURCE_SLOTS + LANG_SLOTS, size / 10), (SOURCE_SLOTS + LANG_SLOTS + 1, size**2 / 100)]


META = SOURCE_SLOTS + LANG_SLOTS + 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class View(NamedTuple):
    """A logistic regression on scaled features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset


class Pull(NamedTuple):
    """Second-order form of more rows' likelihood around ``at``."""

    at: np.ndarray
    gradient: np.ndarray
    curve: np.ndarray


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float,
             pull: Pull | None = None) -> np.ndarray:
    """Weights and intercept by Newton's method with a ridge."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    damp = np.full(len(w), ridge)
    damp[-1] = 1e-6
    for _ in range(25):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + damp * w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(damp)
        if pull is not None:
            gradient = gradient + pull.gradient + pull.curve @ (w - pull.at)
            curve = curve + pull.curve
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, sums: "list[Sums] | None" = None,
        before: View | None = None) -> View:
    """A view of labelled rows; ``sums`` are those of pseudo-labels 0 and 1 at
    the weights of the view ``before``."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    # Both classes weigh the same, so that rare bad documents count.
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    pull = None
    if sums is not None:
        own = [min(1.0, INFLUENCE * (y == c).sum() / max(s.n, 1.0)) * (0.5 / (share if c else 1 - share))
               for c, s in enumerate(sums)]
        pull = Pull(before.weights, sum(w * s.gradient for w, s in zip(own, sums, strict=True)),
                    sum(w * s.curve for w, s in zip(own, sums, strict=True)))
    return View(mean, scale, logistic(z, y, weight, ridge, pull), 1.0, 0.0)


class Sums(NamedTuple):
    """Number, gradient and curvature of pseudo-labelled rows of one class."""

    n: float
    gradient: np.ndarray
    curve: np.ndarray


def pool_sums(history: list[tuple[View, View]], views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of some unlabelled rows, flat: by learning view, then by label."""
    out = []
    for v in range(2):
        label = np.full(len(views[0]), -1)
        for turn in history:   # the first confident label of the other view
            p = sigmoid(turn[1 - v].log_odds(views[1 - v]))
            new = np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1))
            label = np.where(label < 0, new, label)
        own = history[-1][v]
        for c in range(2):
            x = views[v][label == c]
            z = np.clip((x - own.mean) / own.scale, -8, 8)
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            p = sigmoid(z @ own.weights)
            curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
            out += [np.array([float(len(x))]), z.T @ (p - c), curve.ravel()]
    return np.concatenate(out)


def unflat(flat: np.ndarray, history: list[tuple[View, View]]) -> list[list[Sums]]:
    """Inverse of the layout of ``pool_sums``."""
    out, at = [], 0
    for v in range(2):
        d, found = len(history[-1][v].weights), []
        for _ in range(2):
            n, gradient = flat[at], flat[at + 1:at + 1 + d]
            at += 1 + d
            found.append(Sums(float(n), gradient, flat[at:at + d * d].reshape(d, d)))
            at += d * d
        out.append(found)
    return out


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling on held-out rows, with the usual smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = logistic(view.raw(x)[:, None], target, np.ones(len(y)), 1e-3)
    return view._replace(slope=float(max(slope, 0.0)), offset=float(offset))


class Model(NamedTuple):
    words: dict[str, int]
    text: View
    meta: View
    prior: float

    def text_rows(self, shapes: list[list[float]], known: list[set[str]]) -> np.ndarray:
        return text_rows(self.words, shapes, known)

    def good(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(self.text.log_odds(text) + self.meta.log_odds(meta) - self.prior)


def text_rows(words: dict[str, int], shapes: list, known: list) -> np.ndarray:
    out = np.zeros((len(shapes), SHAPES + len(words)))
    out[:, :SHAPES] = np.array(shapes, dtype=float).reshape(-1, SHAPES)
    for i, own in enumerate(known):
        for w in own & words.keys():
            out[i, SHAPES + words[w]] = 1
    return out


def meta_rows(sources: list, langs: list, sizes: list) -> np.ndarray:
    out = np.zeros((len(sources), META))
    for i, row in enumerate(zip(sources, langs, sizes, strict=True)):
        for at, value in metadata(*row):
            out[i, at] = value
    return out


def co_train(words: dict[str, int], text: np.ndarray, meta: np.ndarray, y: np.ndarray,
             pool: Callable[[list[tuple[View, View]]], np.ndarray] | None,
             rounds: int = ROUNDS) -> Model:
    """Rounds of exchange between the views, each calibrated on held-out rows.

    ``pool`` gives the sums of all unlabelled rows for a history of views.
    """
    held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), np.bool_)
    learn, check = ~held, held if held.any() else ~held
    rows = (text, meta)

    def learned(sums: list, before: tuple) -> tuple[View, View]:
        return tuple(calibrate(fit(x[learn], y[learn], sums=s, before=b), x[check], y[check])
                     for x, s, b in zip(rows, sums, before, strict=True))

    history = [learned([None, None], (None, None))]
    for _ in range(rounds if pool else 0):
        history.append(learned(unflat(pool(history), history), history[-1]))
    share = np.clip(y[check].mean(), 1e-3, 1 - 1e-3)
    return Model(words, *history[-1], float(np.log(share / (1 - share))))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y) of labelled rows; bounded."""
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    judged = judged.groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0))
        .alias("y"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    return least_hashed(ids.join(judged, "doc_id"), "doc_id", sample)


def telling_words(rows: DataFrame, limit: int = WORDS) -> list[str]:
    """Words whose presence goes with the label most, by chi-square."""
    words = F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    judged = rows.where("y IS NOT NULL")
    n, good = judged.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or good in (0, n):
        return []
    share = good / n
    counts = judged.select(F.explode(words).alias("word"), "y").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).where(F.col("n") >= MIN_SUPPORT)
    chi = (F.col("good") - F.col("n") * share) ** 2 / (F.col("n") * share * (1 - share))
    found = counts.select("word", chi.alias("chi")).where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "word").limit(limit)
    return [r.word for r in found.collect()]


FEATURES = ("doc_id long, y double, source string, lang string, n_chars long, "
            "shape array<double>, hits array<int>")


def features(rows: DataFrame, words: dict[str, int]) -> DataFrame:
    """``FEATURES`` of ``rows`` (doc_id, text, source, lang, n_chars, y)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [shape(t) for t in batch.column(1).to_pylist()]
            hits = [sorted(words[w] for w in known & words.keys()) for _, known in seen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), batch.column(2), batch.column(3),
                 batch.column(4), pa.array([s for s, _ in seen], pa.list_(pa.float64())),
                 pa.array(hits, pa.list_(pa.int32()))], [f.split()[0] for f in FEATURES.split(", ")])

    return rows.select("doc_id", "text", "source", "lang", "n_chars", "y").mapInArrow(run, FEATURES)


def view_rows(words: dict[str, int], table: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Both views' rows of a table of features."""
    named = list(words)
    text = text_rows(words, table["shape"], [{named[i] for i in h} for h in table["hits"]])
    return text, meta_rows(table["source"], table["lang"], table["n_chars"])


def spark_pool(unlabelled: DataFrame, words: dict[str, int]):
    """Sums of a written table of features, by tasks, then by pieces."""
    spark = unlabelled.sparkSession

    def sums(history: list[tuple[View, View]]) -> np.ndarray:
        shared = spark.sparkContext.broadcast(history)   # some hundred weights a view

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    own = pool_sums(shared.value, view_rows(words, batch.to_pydict()))
                    total = own if total is None else total + own
            cut = [] if total is None else np.array_split(total, PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(cut)), pa.int32()),
                 pa.array([c.tobytes() for c in cut], pa.binary())], ["piece", "part"])

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.frombuffer(p.as_buffer(), np.float64)
                    held[i] = held[i] + own if i in held else own.copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()),
                 pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "part"])

        kind = "piece int, part binary"
        parts = unlabelled.select("source", "lang", "n_chars", "shape", "hits").mapInArrow(
            partial, kind).repartition(PIECES, "piece").mapInArrow(reduce, kind)
        found = sorted((r["piece"], r["part"]) for r in parts.collect())   # PIECES rows
        if not found:
            return np.zeros(sum(2 * (1 + len(w) + len(w) ** 2) for w in (
                v.weights for v in history[-1])))
        return np.concatenate([np.frombuffer(p, np.float64) for _, p in found])

    return sums


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of ``docs`` (doc_id, text, source, lang, n_chars); None without
    labels of both kinds."""
    python_ready(docs.sparkSession)
    chosen = staged(sample_rows(docs, labels, sample), "labelled")
    rows = docs.select("doc_id", whole_text().alias("text"), F.col("source").cast("string"),
                       F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    judged = rows.join(F.broadcast(chosen), "doc_id").persist()   # a bounded sample
    words = {w: i for i, w in enumerate(telling_words(judged))}
    table = features(judged, words).toPandas().sort_values("doc_id", kind="stable")
    judged.unpersist()
    y = table["y"].to_numpy(dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    lists = {c: table[c].tolist() for c in ("source", "lang", "n_chars", "shape", "hits")}
    lists["source"], lists["lang"] = ([None if x is None or x != x else x for x in lists[c]]
                                      for c in ("source", "lang"))
    lists["n_chars"] = [None if x is None or x != x else int(x) for x in lists["n_chars"]]
    text, meta = view_rows(words, lists)
    others = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").withColumn(
        "y", F.lit(None).cast("double"))
    unlabelled = staged(features(others, words), "unlabelled")
    return co_train(words, text, meta, y, spark_pool(unlabelled, words))


def score(df: DataFrame, model: Model | None) -> DataFrame:
    """``df`` with ``p_text``, ``p_meta``, ``p_good`` and ``kept``."""
    added = ("p_text", "p_meta", "p_good", "kept")
    df = cleared(df, added)
    if model is None:
        return df.withColumns({n: F.lit(1.0) for n in added[:3]} | {"kept": F.lit(True)})
    spark = df.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = df.select("*", *[F.lit(0.0).alias(n) for n in added[:3]],
                       F.lit(True).alias("kept")).schema
    at = {n: df.columns.index(n) for n in ("text", "source", "lang", "n_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for n, i in at.items()}
            seen = [shape(t or "") for t in column["text"]]
            text = own.text_rows([s for s, _ in seen], [k for _, k in seen])
            meta = meta_rows(column["source"], column["lang"], column["n_chars"])
            good = own.good(text, meta)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sigmoid(own.text.log_odds(text))),
                 pa.array(sigmoid(own.meta.log_odds(meta))), pa.array(good),
                 pa.array(good >= KEEP_FROM)], [*batch.schema.names, *added])

    return map_batches(df, run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).drop("text", "source", "lang", "n_chars")
