"""Operator 3: removal of repeated substrings by sorting suffixes.

Every byte is removed that is covered by a 100-byte string which also starts
earlier in the corpus (in a smaller document, or earlier in the same one);
strings are judged on the input.

A suffix array of every byte doesn't shuffle at corpus scale, so suffixes are
sorted around anchors. The anchor of a 100-byte window is the place of its
least 32-byte gram by hash (the leftmost of equal ones). It depends on the
window's bytes alone, so equal windows have equal anchors at equal distance,
and about one place in 35 is an anchor.

1. Grams of anchors are counted; those seen once hold no repeat. The others
   are known to all tasks as a Bloom filter of at most 64 MB. It only saves
   shuffling: a false hit costs a row and changes nothing.
2. Every anchor left yields the bytes of all its windows as its context.
   (gram, context) classes keep their earliest member, with map-side combine.
   All other members are repeats of it in whole, however many they are.
3. The earliest members of classes that share a gram are sorted by their bytes
   to the right and to the left of the anchor (deep-shallow sorting). Windows
   are equal if both sides agree far enough, and all but the earliest of equal
   windows are repeats.
4. A gram with more than ``HOT`` classes (the edge of a passage in much of the
   corpus) isn't sorted in one task. The range of its windows' distances to the
   anchor is halved, and each half of a class becomes a row with the bytes of
   its own windows. All windows of a half share the bytes around the anchor
   that the half's range implies; those join the key. Rows of equal key and
   bytes are one class again (inside a passage nearly all of them are), and
   steps 2 to 4 repeat. A half of one window has one class for each key, so at
   most seven halvings are made; only classes of still hot keys are halved.

Joins that put the results back together are sort-merge joins that adaptive
execution may split. Texts are shuffled once, to meet their spans.

Defined results: null or empty text has no bytes; texts of under 100 bytes
keep all; rows of equal id and text count as one document and get the same
result, rows of equal id and other text are ordered by a hash of the text, and
null ids come first; an empty table gives an empty table; other columns stay,
and one that has an output's name is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import (cleared, columns, discard, documents, map_batches,
                               python_ready, staged, whole_text)
from quarry.llm.deepshallow import sort_with_prefixes
from quarry.session import bounded_broadcast

WINDOW = 100            # bytes of a repeated string
GRAM = 32               # bytes of an anchor's gram (a power of two)
HOT = 4096              # classes of a key sorted in one task
BLOCK_BYTES = 2 << 20   # bytes hashed at a time
FILTER_BITS = 20        # log2 of the bits of a block of the Bloom filter
FILTER_BLOCKS = 512     # blocks at most (64 MB)
FILTER_LOAD = 16        # bits per gram below that bound

NO_ID = -(1 << 63)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)   # odd multipliers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * M1
    return (h ^ h >> np.uint64(32)) * M2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes at each place, by doubling."""
    h = mixed(np.arange(1, 257, dtype=np.uint64))[data]
    size = 1
    while size < GRAM:
        h = (h[:-size] ^ h[:-size] >> np.uint64(31)) * M1 + h[size:]
        size *= 2
    h = mixed(h)
    return h ^ h >> np.uint64(32)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least (by its upper half) of each ``width`` hashes."""
    value = (h >> np.uint64(32)).astype(np.uint32)
    place = np.arange(len(h), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        take = value[step:] < value[:-step]
        place = np.where(take, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        size += step
    return place


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first window, last window) of each anchor.

    ``data`` holds several texts one after another; ``ends`` are their ends.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none.view(np.uint64), none, none, none
    h = gram_hashes(data)
    place = least_places(h, WINDOW - GRAM + 1)
    sizes = np.diff(ends, prepend=0)
    last = np.repeat(ends, sizes)[:len(place)]
    at = np.nonzero(np.arange(len(place)) + WINDOW <= last)[0]
    if not len(at):
        return none.view(np.uint64), none, none, none
    place = place[at]
    new = np.nonzero((np.diff(place) != 0) | (np.diff(at) != 1))[0] + 1
    first = np.concatenate([[0], new])
    final = np.concatenate([new - 1, [len(at) - 1]])
    return h[place[first]], place[first].astype(np.int64), at[first], at[final]


def blocks(text: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, rows, offsets) of runs of texts of some MB each.

    A text longer than a block comes in pieces that overlap by a window less
    one byte, so each window is in just one piece.
    """
    begin = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    parts: list[tuple[int, int, int]] = []
    held = 0
    for row in range(len(text)):
        s, e = int(begin[row]), int(begin[row + 1])
        for at in range(s, max(s + 1, e - WINDOW + 1), BLOCK_BYTES):
            stop = min(e, at + BLOCK_BYTES + WINDOW - 1)
            parts.append((row, at, stop))
            held += stop - at
            if held >= BLOCK_BYTES:
                yield joined(data, begin, parts)
                parts, held = [], 0
    if parts:
        yield joined(data, begin, parts)


def joined(data: np.ndarray, begin: np.ndarray, parts: list[tuple[int, int, int]]):
    rows = np.array([r for r, _, _ in parts], np.int64)
    starts = np.array([s for _, s, _ in parts], np.int64)
    sizes = np.array([e - s for _, s, e in parts], np.int64)
    return (np.concatenate([data[s:e] for _, s, e in parts]), np.cumsum(sizes), rows,
            starts - begin[rows])


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, th, text): a document is its id and a hash of its text."""
    t = whole_text(text)
    return df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"),
                     F.xxhash64(t).alias("th"), t.alias("text"))


def repeated_grams(texts: DataFrame) -> DataFrame:
    """Grams that are an anchor's twice or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, _, _ in blocks(batch.column(0)):
                gram, n = np.unique(anchors(data, ends)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

    counted = texts.select("text").mapInArrow(run, "gram long, n int")
    return counted.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def bloom_filter(grams: DataFrame) -> np.ndarray:
    """(blocks, bytes) of a Bloom filter built in blocks by the tasks."""
    n = grams.count()
    size = 1 << FILTER_BITS
    count = min(FILTER_BLOCKS, max(1, math.ceil(n * FILTER_LOAD / size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, gram = (np.asarray(c) for c in batch.columns)
            for b in np.unique(block).tolist():
                bits = held.setdefault(b, np.zeros(size, np.bool_))
                own = gram[block == b].view(np.uint64)
                bits[own & np.uint64(size - 1)] = True
                bits[own >> np.uint64(FILTER_BITS) & np.uint64(size - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()),
             pa.array([np.packbits(b).tobytes() for b in held.values()], pa.binary())],
            ["block", "bits"])

    dealt = grams.select((F.shiftrightunsigned("gram", 2 * FILTER_BITS) % count).cast("int")
                         .alias("block"), "gram").repartition(count, "block")
    table = np.zeros((count, size // 8), np.uint8)
    for row in dealt.mapInArrow(run, "block int, bits binary").collect():
        table[row.block] |= np.frombuffer(row.bits, np.uint8)
    return table


def maybe_in(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    block = (gram >> np.uint64(2 * FILTER_BITS)) % np.uint64(len(table))
    found = np.ones(len(gram), np.bool_)
    for shift in (0, FILTER_BITS):
        bit = gram >> np.uint64(shift) & np.uint64((1 << FILTER_BITS) - 1)
        byte = table[block, bit >> np.uint64(3)]
        found &= (byte >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return found


MEMBERS = ("gram long, context_key long, doc long, th long, place int, least int, most int, "
           "context binary")


def members(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """Anchors whose gram may repeat.

    ``least`` and ``most`` bound the distance from a window's start to the
    anchor. The context's bytes go with its first row in a block only.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            docs, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for data, ends, rows, offsets in blocks(batch.column(2)):
                gram, place, first, last = anchors(data, ends)
                keep = maybe_in(known, gram)
                gram, place, first, last = gram[keep], place[keep], first[keep], last[keep]
                part = np.searchsorted(ends, place, side="right")
                least, most = place - last, place - first
                raw, keys, contexts, seen = data.tobytes(), [], [], set()
                for s, e, x, y in zip(first.tolist(), (last + WINDOW).tolist(),
                                      least.tolist(), most.tolist(), strict=True):
                    context = raw[s:e]
                    key = xxhash.xxh64_intdigest(context, x << 8 | y)
                    keys.append(key)
                    contexts.append(None if key in seen else context)
                    seen.add(key)
                inside = place - np.concatenate([[0], ends[:-1]])[part] + offsets[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)),
                     pa.array(np.array(keys, np.uint64).view(np.int64)),
                     pa.array(docs[rows[part]]), pa.array(hashes[rows[part]]),
                     pa.array(inside.astype(np.int32)), pa.array(least.astype(np.int32)),
                     pa.array(most.astype(np.int32)), pa.array(contexts, pa.binary())],
                    [f.split()[0] for f in MEMBERS.split(", ")])

    return texts.mapInArrow(run, MEMBERS)


def repeats(groups: list[list[tuple[int, int, bytes]]]) -> np.ndarray:
    """(member, distance) of windows that are equal to an earlier one's.

    ``groups`` hold (least, most, context) in corpus order; members are
    numbered through all groups.
    """
    n = sum(map(len, groups))
    least, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, prefix = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
    at = 0
    for group in groups:
        rows = slice(at, at + len(group))
        least[rows] = [x for x, _, _ in group]
        most[rows] = [y for _, y, _ in group]
        sides = ([c[y:] for _, y, c in group], [c[:y][::-1] for _, y, c in group])
        for side, strings in enumerate(sides):
            o, before = sort_with_prefixes(strings)
            order[side, rows] = np.array(o) + at
            prefix[side, rows] = before
        at += len(group)
    found = []
    runs = np.zeros((2, n), np.int64)
    for distance in range(int(least.min()), int(most.max()) + 1) if n else ():
        for side, depth in ((0, WINDOW - distance), (1, distance)):
            # A group's first has prefix -1, so runs never cross groups.
            runs[side, order[side]] = np.cumsum(prefix[side] < depth)
        have = np.nonzero((least <= distance) & (distance <= most))[0]
        window = runs[0, have] * (n + 1) + runs[1, have]
        _, first = np.unique(window, return_index=True)
        later = np.ones(len(have), np.bool_)
        later[first] = False
        found.append(np.stack([have[later], np.full(later.sum(), distance)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def sorted_spans(classes: DataFrame) -> DataFrame:
    """(doc, th, lo, hi) of repeats among the classes of each key."""
    def spans(groups: list, reps: list) -> pa.RecordBatch:
        again = repeats(groups)
        doc, th, place = (np.array([r[i] for r in reps], np.int64) for i in range(3))
        who, distance = again[:, 0], again[:, 1]
        # Windows next to each other make one span.
        by = np.lexsort((distance, who))
        who, distance = who[by], distance[by]
        new = np.concatenate([[True], (np.diff(who) != 0) | (np.diff(distance) != 1)])[:len(who)]
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:] - 1, [len(who) - 1]])[:len(first)]
        m = who[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[m]), pa.array(th[m]), pa.array(place[m] - distance[last]),
             pa.array(place[m] - distance[first] + WINDOW)], ["doc", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, reps, key, ready = [], [], None, 0
        for batch in batches:
            for k, doc, th, place, least, most, context in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if ready >= HOT:
                        yield spans(groups, reps)
                        groups, reps, ready = [], [], 0
                    groups.append([])
                    key = k
                groups[-1].append((least, most, context))
                reps.append((doc, th, place))
                ready += 1
        if groups:
            yield spans(groups, reps)

    ordered = ["key", "doc", "th", "place", "least"]
    return (classes.select("key", "first.doc", "first.th", "first.place", "first.least",
                           "first.most", "context")
            .repartition(F.col("key")).sortWithinPartitions(*ordered)
            .mapInArrow(run, "doc long, th long, lo long, hi long"))


def halved(classes: DataFrame) -> DataFrame:
    """The rows of both halves of each class's range of distances.

    The anchor is ``most`` bytes into a context.
    """
    def half(low: Column, high: Column) -> Column:
        least = F.greatest(F.col("first.least"), low)
        most = F.least(F.col("first.most"), high)
        context = F.substring("context", F.col("first.most") - most + 1, most - least + WINDOW)
        # From ``low`` bytes before the anchor to the end of a window at ``high``.
        around = F.substring("context", F.col("first.most") - low + 1, low - high + WINDOW)
        made = F.struct(F.xxhash64("key", low, around).alias("key"), low.alias("lo"),
                        high.alias("hi"), F.xxhash64(context, least, most).alias("context_key"),
                        least.alias("least"), most.alias("most"), context.alias("context"))
        return F.when(least <= most, made)

    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(half(F.col("lo"), middle), half(middle + 1, F.col("hi")))
    each = classes.select("first.doc", "first.th", "first.place", F.explode(both).alias("h"))
    return each.where(F.col("h").isNotNull()).select("doc", "th", "place", "h.*")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, th, spans): byte ranges to remove, not merged."""
    grams = staged(repeated_grams(texts), "grams")
    anchored = staged(members(texts, bloom_filter(grams)), "anchors")
    rows = anchored.select(
        F.col("gram").alias("key"), F.lit(0).alias("lo"), F.lit(WINDOW - GRAM).alias("hi"),
        "context_key", "doc", "th", "place", "least", "most", "context")
    place = F.struct("doc", "th", "place", "least", "most")
    spans, used = [], [grams, anchored]
    while True:
        classes = staged(rows.groupBy("key", "context_key").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
            F.max("context").alias("context"), F.max("lo").alias("lo"), F.max("hi").alias("hi")),
            "contexts")
        whole = classes.where("n > 1").select("key", "context_key", "first")
        spans.append(rows.drop("context", "lo", "hi").join(whole, ["key", "context_key"]).where(
            place != F.col("first")).select(
            "doc", "th", (F.col("place") - F.col("most")).cast("long").alias("lo"),
            (F.col("place") - F.col("least") + WINDOW).cast("long").alias("hi")))
        shared = staged(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"))
                        .where("classes > 1"), "shared")
        used += [classes, shared]
        spans.append(sorted_spans(classes.join(shared.where(F.col("classes") <= HOT), "key")))
        over = shared.where(F.col("classes") > HOT)
        if over.isEmpty():
            break
        # Such keys are few: each stands for more than ``HOT`` classes.
        rows = halved(classes.join(bounded_broadcast(over.select("key"))[0], "key"))
    found = spans[0]
    for more in spans[1:]:
        found = found.union(more)
    written = staged(found, "spans")
    discard(*used)   # before the texts are shuffled; only the spans are read from here on
    return written.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


OUTPUT = {"kept": "binary", "removed": "array<struct<lo:bigint,hi:bigint>>"}


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   as_text: bool = False) -> DataFrame:
    """``df`` with ``kept`` (the bytes left) and ``removed`` (maximal byte ranges).

    With ``as_text``, ``kept`` is a string; characters that lost some of their
    bytes to a range are left out.
    """
    df = cleared(df, [*OUTPUT, "_doc", "_th", "_spans"], [doc_id, text])
    python_ready(df.sparkSession)
    texts = keyed(df, doc_id, text)
    spans = repeated_spans(texts).select(
        F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    whole = df.withColumns({
        "_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
        "_th": F.xxhash64(whole_text(text))})
    met = whole.join(spans, ["_doc", "_th"], "left").select(*columns(df), "_spans")
    at = df.columns.index(text)
    schema = met.drop("_spans").select(
        "*", F.lit(None).cast("string" if as_text else "binary").alias("kept"),
        F.lit(None).cast(OUTPUT["removed"]).alias("removed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            kept, removed = [], []
            for t, s in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(),
                            strict=True):
                data, ranges = (t or "").encode("utf-8"), merged(s or [])
                cuts = [0, *(x for r in ranges for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                removed.append([{"lo": a, "hi": b} for a, b in ranges])
            if as_text:
                kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            else:
                kept = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], kept, pa.array(removed, kind)],
                [*batch.schema.names[:-1], *OUTPUT])

    return map_batches(met, run, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 100-byte strings."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    sizes = F.transform("removed", lambda r: r["hi"] - r["lo"])
    return remove_repeats(docs).select(
        "doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
