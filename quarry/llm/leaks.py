"""Operator 13: benchmark decontamination by a broadcast set of test n-grams.

Words are runs of ``0-9``, ``a-z`` and characters from U+0080 on, after A-Z
are lowered. A window is ten consecutive words of a benchmark item; an item of
fewer words (but not none) is one window. The distinct windows, keyed by a
64-bit hash, are broadcast; every document lists the hashes of its own windows
(one list per window length that occurs, ten lengths at most) and probes the
set as the list is exploded (hashes of windows are made from those of their
halves, in a few passes over the words), so window rows that meet nothing end inside the
scan's stage. A hash that meets is verified on the words themselves. Only hits
and one row per document are shuffled.

The set is broadcast in one piece up to ``BLOCK_WINDOWS`` windows. A larger
benchmark is cut into blocks of at most that many by hash, and the documents
are scanned once per block; results are the same for any number of blocks.

Everything is built-in functions: no Python runs on rows.

Defined results: null or empty text has no words and is clean; a null item
text has no windows; windows of an item with a null id mark words but list no
item; repeated items and ids count once; rows that repeat an id and text each
get their row; an empty benchmark finds nothing; an empty table gives an empty
table; extra columns pass through ``decontaminate`` and are ignored by
``find``; very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import columns, dealt, documents, staged, table, whole_text

WINDOW = 10
GAPS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
# A word, and what lies between words, before A-Z are lowered.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Pairs of window and item in one broadcast: ten words and an id each, so some
# 100 MB in an executor. Benchmarks of about 10,000 items fit into one block.
BLOCK_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Words of ``text``, A-Z lowered."""
    line = F.trim(F.translate(text, UPPER + GAPS, LOWER + " " * len(GAPS)))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " +"))


def with_powers(df: DataFrame, size: int) -> DataFrame:
    """``df(ws, ...)`` with ``_p1``, ``_p2``, ``_p4``, ...: hashes of the words,
    and of the windows of each power of two up to ``size`` by doubling."""
    df = df.withColumn("_p1", F.transform("ws", lambda w: F.xxhash64(w)))
    width = 1
    while 2 * width <= size:
        df = df.withColumn(f"_p{2 * width}", beside(
            F.col(f"_p{width}"), F.col(f"_p{width}"), width,
            F.greatest(F.size("ws") - (2 * width - 1), F.lit(0))))
        width *= 2
    return df


def beside(a: Column, b: Column, apart: int, n: Column) -> Column:
    """Hashes of the first ``n`` of ``a``, each with that of ``b`` ``apart`` on."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + apart), n),
                      lambda x, y: F.xxhash64(x, y))


def window_hashes(size: int) -> Column:
    """Hash of each window of ``size`` words, from the columns of ``with_powers``."""
    n = F.greatest(F.size("ws") - (size - 1), F.lit(0))
    width = 1 << (size.bit_length() - 1)
    found, done = F.slice(f"_p{width}", F.lit(1), n), width
    while done < size:
        width = 1 << ((size - done).bit_length() - 1)
        found, done = beside(found, F.col(f"_p{width}"), done, n), done + width
    return found


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """(ws, items): every distinct window and the ids of its items."""
    listed = benchmark.select(F.col(item_id).cast("string").alias("item"),
                              words(whole_text(text)).alias("ws"))
    short = F.size("ws") < window
    whole = F.when(short, F.array("ws")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1))),
        lambda i: F.slice("ws", i, F.lit(window))))
    single = listed.where(F.size("ws") > 0).select("item", F.explode(whole).alias("w"))
    return single.groupBy(F.col("w").alias("ws")).agg(F.collect_set("item").alias("items"))


def probe(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits of ``docs(id, hash, ws)`` as (id, hash, at, n, items), and one row
    with ``at`` -1 per document, whose ``n`` is its count of words."""
    longest = max(lengths, default=1)
    size = F.size("ws")
    own = F.lit(None).cast("long")
    for length in lengths:
        own = F.when(size == length, F.element_at(window_hashes(length), 1)).otherwise(own)
    known = with_powers(windows, longest).select(
        own.alias("_h"), F.col("ws").alias("_words"), "items")

    head = F.array(F.lit(None).cast("long"))
    listed = F.concat(head, *[window_hashes(length) for length in lengths])
    # The outer form: nothing is inferred from it that would be computed twice.
    each = with_powers(docs, longest).select(
        "id", "hash", "ws", F.posexplode_outer(listed).alias("pos", "h"))
    met = each.join(F.broadcast(known), F.col("h") == F.col("_h"), "left")
    # ``pos`` runs through the head and the windows of each length in turn.
    at, n, before = F.col("pos") - 1, F.lit(0), F.lit(0)
    for length in lengths:
        inside = F.col("pos") > before
        at = F.when(inside, F.col("pos") - 1 - before).otherwise(at)
        n = F.when(inside, F.lit(length)).otherwise(n)
        before = before + F.greatest(size - (length - 1), F.lit(0))
    # Words are compared after the join, so that only the hash is its key.
    first = F.col("pos") == 0
    same = F.col("_h").isNotNull() & (F.slice("ws", F.greatest(at, F.lit(0)) + 1, n)
                                      == F.col("_words"))
    return met.where(first | same).select(
        "id", "hash", F.when(first, -1).otherwise(at).alias("at"),
        F.when(first, size).otherwise(n).alias("n"), "items")


def merged(places: Column) -> Column:
    """Sorted (at, n) windows as maximal runs (start, end), ends exclusive."""
    empty = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"),
                     F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    shut = lambda s: F.when(s["start"] >= 0, F.concat(                       # noqa: E731
        s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
    )).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        grows = (s["start"] >= 0) & (x["at"] <= s["end"])
        return F.struct(
            F.when(grows, s["done"]).otherwise(shut(s)).alias("done"),
            F.when(grows, s["start"]).otherwise(x["at"]).alias("start"),
            F.when(grows, F.greatest(s["end"], x["at"] + x["n"]))
            .otherwise(x["at"] + x["n"]).alias("end"))

    return F.aggregate(places, empty, step, shut)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, copies, n_words, n_hit, spans, items) of every
    distinct pair of id and text; ``copies`` rows hold it. ``spans`` are word
    positions, ends exclusive; ``items`` are ids as strings, sorted."""
    windows = staged(item_windows(benchmark, item_id, item_text, window), "windows")
    by_length = windows.groupBy(F.size("ws").alias("size")).agg(
        F.sum(F.greatest(F.size("items"), F.lit(1))).alias("n")).collect()   # <= ``window`` rows
    lengths = sorted(r["size"] for r in by_length)
    blocks = max(1, math.ceil(sum(r["n"] for r in by_length) / block_windows))
    whole = whole_text(text)
    listed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(whole).alias("hash"),
                         words(whole).alias("ws"))
    found = None
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("ws"), F.lit(blocks)) == block)
        rows = probe(listed, part, lengths)
        if block:   # documents are counted in the first pass
            rows = rows.where("at >= 0")
        found = rows if found is None else found.unionByName(rows)
    hit = F.col("at") >= 0
    grouped = found.groupBy("id", "hash").agg(
        F.count_if(~hit).alias("copies"),
        F.max(F.when(~hit, F.col("n"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("at", "n")))).alias("places"),
        F.collect_set("items").alias("items"))
    spans = grouped.withColumn("spans", merged(F.col("places")))
    return spans.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), "copies", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        .alias("n_hit"),
        "spans", F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and the gaps before them."""
    parts = F.regexp_extract_all(text, F.lit(f"{GAP}{WORD_ANY}"), 0)
    kept = F.filter(parts, lambda p, i: ~F.exists(
        spans, lambda s: (s["start"] <= i) & (i < s["end"])))
    read = F.aggregate(parts, F.lit(0), lambda n, p: n + F.char_length(p))
    return F.concat(F.array_join(kept, ""), F.substr(text, read + 1))


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = False,
                  doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the hit words, or with ``whole`` without the hit documents.

    All columns stay. The table of hit documents is broadcast where its rows
    and spans are within bounds, else it is joined by shuffle on id and text.
    """
    found = staged(find(docs, benchmark, doc_id, text, **settings).where("n_hit > 0").select(
        F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash"),
        F.col("spans").alias("_leak_spans")), "leaks")
    cells = found.agg(F.sum(F.size("_leak_spans") + 1)).first()[0] or 0
    if cells <= BLOCK_WINDOWS:
        found = F.broadcast(found)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_leak_id")) & (
        F.xxhash64(whole_text(text)) == F.col("_leak_hash"))
    if whole:
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    cut = F.when(F.col("_leak_spans").isNull(), F.col(f"`{text}`")).otherwise(
        without_spans(F.col(f"`{text}`"), F.col("_leak_spans")))
    return joined.select(*[cut.alias(c) if c == text else x
                           for c, x in zip(docs.columns, columns(docs), strict=True)])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items met."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, dealt(table(spark, sf_dir, "benchmark")))
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            f"'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_sql_words('text')} AS ws FROM documents),
b AS (SELECT item_id, {_sql_words('text')} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n,
  array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - {WINDOW - 1}, 1))) AS i
        FROM b WHERE len(ws) > 0)),
dw AS (SELECT k, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT k, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dw.k, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
w AS (SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT k, i, n FROM h))
  GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL)
  GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (k) LEFT JOIN t USING (k)
"""
