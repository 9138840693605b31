"""Operator 11: tokens of two tokenizers aligned by merge-path partitioning.

A text is encoded by a byte-level BPE (A, over a space and the text) and by a
sentencepiece model (B, which adds the space itself). Both give the byte
offsets at which their tokens end. Merging the two ascending lists of ends
cuts the text into the overlaps of A with B tokens; an offset where both end
closes a group.

Merge path: the texts of a block are laid end to end, so that their ends are
two long ascending lists. Diagonals of the merge grid, ``PIECE`` steps apart,
are each located by a binary search (all at once), which divides the merge
into independent pieces of equal work, whatever the lengths of the texts. A
piece sees its own ends only and emits its overlaps and closed groups. An end
of B that opens a piece may close a group with the last end of the piece
before: such open ends are stitched afterwards.

A's ids come from the tokenizers library, or for texts whose characters have
had the same classes in all Unicode versions (Latin, common punctuation) from
tiktoken, built from the same file, in a quarter of the time. That is done only
where the file's merges are in order of the ids they make, which makes both the
same; ``Pair`` checks that.

Texts are encoded in blocks of about ``BLOCK_BYTES``. A longer text is cut at
places where neither tokenizer can join what lies on both sides (a space after
a character that isn't white space), so that working memory doesn't grow with
a text except where it has no such place.

Counts of linked id pairs over the whole corpus: every row holds its distinct
pairs with their numbers; these are summed by pair (with map-side combine),
and come back to the rows by a join on the pair, broadcast where the table of
distinct pairs is within bounds. Rows carry a number of their own, so repeated
and null ids don't matter.

Defined results: a null or empty text, and one whose joined A or B bytes
aren't a space and the text (as with U+2581), has no tokens: zeros, empty
``groups``, no links. Special tokens' strings are plain text. Repeated rows
count each; an empty table gives an empty table; other columns stay, and one
that has an output's name is replaced by it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import share
from quarry.llm.common import cleared, documents, map_batches, python_ready, staged, whole_text
from quarry.session import bounded_broadcast

BLOCK_BYTES = 1 << 20   # text of a block
PIECE = 1 << 14         # merge steps of a piece
ID_BITS = 20            # ids are below 2^20
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "links")

# A place to cut a long text: a space after a character that isn't white space.
CUT = re.compile(r"(?<=\S) (?!\Z)")
# Fixed value: the pattern of byte-level vocabularies.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHANGING = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
JOINS_WORDS = re.compile("[^▁]▁")   # a piece that would span such a place

_LOADED: dict[tuple[int, int], "Pair"] = {}


class Tokens(NamedTuple):
    """Ids of several texts one after the other, and where each text's begin."""

    ids: np.ndarray
    starts: np.ndarray    # one more than there are texts


def byte_of_letter() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte.

    Printable Latin-1 characters stand for themselves, the other bytes in
    order for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def ranked(spec: dict, letter: dict[str, int]):
    """tiktoken's coder of a plain byte-level BPE file; None if it may differ.

    It merges the pair that makes the least id, the file's first merge: the
    same if merges are in order of the ids they make.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not model.get("dropout")
             and not model.get("byte_fallback") and spec.get("normalizer") is None
             and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space"))
    if not plain:
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    single = [vocab.get(c) for c in letter]
    if None in made or None in single or any(x >= y for x, y in pairwise([max(single), *made])):
        return None
    import tiktoken

    kept = {*single, *made}
    ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if i in kept}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letter = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letter[c] for c in token)
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.ranked = ranked(json.loads(a_file), letter)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # The longest part of a text that is encoded at once.
        spans = any(JOINS_WORDS.search(self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        self.part = sys.maxsize if spans else BLOCK_BYTES
        # Written forms: an id followed by what comes after it.
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.written = {s: np.array([f"{i}{s}" for i in range(n)], object) for s in ",|;"}

    def piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return (bytes([int(name[3:5], 16)]) if self.b.is_byte(i)
                else name.replace("▁", " ").encode("utf-8"))

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        slow = [not self.ranked or bool(CHANGING.search(p)) for p in parts]
        made = iter(self.a.encode_batch_fast([p for p, s in zip(parts, slow, strict=True) if s],
                                             add_special_tokens=False))
        return [next(made).ids if s else self.ranked.encode_ordinary(p)
                for p, s in zip(parts, slow, strict=True)]

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of A and B; none for texts that they don't give back."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            if text:
                cut = chunks(text, self.part)
                parts.extend(cut)
                owner.extend([i] * len(cut))
        a = self.encode_a([" " + p for p in parts])
        b = self.b.encode(parts, num_threads=1) if parts else []
        good = np.ones(len(texts), bool)
        for i, p, x, y in zip(owner, parts, a, b, strict=True):
            whole = b" " + p.encode("utf-8")
            if (b"".join([self.a_bytes[t] for t in x]) != whole
                    or b"".join([self.b_bytes[t] for t in y]) != whole):
                good[i] = False
        return gathered(a, owner, good), gathered(b, owner, good)


def chunks(text: str, size: int) -> list[str]:
    """``text`` in parts of ``size`` characters or more, each but the first
    without the space before it, which encoding puts back."""
    found, start = [], 0
    while len(text) - start > size:
        place = CUT.search(text, start + size)
        if not place:
            break
        found.append(text[start:place.start()])
        start = place.end()
    found.append(text[start:])
    return found


def gathered(lists: list[list[int]], owner: list[int], good: np.ndarray) -> Tokens:
    sizes = np.zeros(len(good), np.int64)
    kept = [(o, np.array(x, np.int32)) for o, x in zip(owner, lists, strict=True) if good[o]]
    for o, x in kept:
        sizes[o] += len(x)
    ids = np.concatenate([x for _, x in kept]) if kept else np.empty(0, np.int32)
    return Tokens(ids, np.concatenate([[0], np.cumsum(sizes)]))


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    """How many ends of A lie before each diagonal ``0, piece, 2 * piece, ...``.

    On equal ends A goes first. All diagonals are searched together.
    """
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        # A's end ``mid`` lies before the diagonal if B's opposite isn't less.
        open_ = low < high
        first = np.zeros(len(at), bool)
        first[open_] = a[mid[open_]] <= b[at[open_] - 1 - mid[open_]]
        low = np.where(open_ & first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return np.stack([low, at - low], axis=1)


class Merged(NamedTuple):
    """One piece's overlaps (token numbers), and its closed groups."""

    a: np.ndarray         # overlaps, ascending
    b: np.ndarray
    closed_a: np.ndarray  # tokens that end a group together
    closed_b: np.ndarray
    open_b: int           # B token whose end opens the piece, or -1


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Merged:
    """Merge ``a[i0:i1]`` with ``b[j0:j1]``, from these ends alone."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    before_a = np.searchsorted(own_b, own_a, "left")     # B ends before each A end
    before_b = np.searchsorted(own_a, own_b, "right")    # A ends up to each B end
    met = np.zeros(len(own_b), bool)
    inner = before_b > 0
    met[inner] = own_a[before_b[inner] - 1] == own_b[inner]
    # An end of both is one overlap, which A's end has emitted.
    single = np.flatnonzero(~met)
    at = np.concatenate([np.arange(len(own_a)) + before_a, single + before_b[single]])
    order = np.argsort(at, kind="stable")
    pair_a = np.concatenate([np.arange(i0, i1), i0 + before_b[single]])[order]
    pair_b = np.concatenate([j0 + before_a, j0 + single])[order]
    both = np.flatnonzero(met)
    opens = len(own_b) > 0 and not before_b[0]
    return Merged(pair_a, pair_b, i0 + before_b[both] - 1, j0 + both, j0 if opens else -1)


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Overlaps (token numbers of A and B) and closed groups (their last tokens)."""
    stitched = [Merged(*[np.empty(0, np.int64)] * 4, -1)]
    for (at, j0), (i1, j1) in pairwise(diagonals(a, b, piece).tolist()):
        p = merge_piece(a, b, at, i1, j0, j1)
        if p.open_b >= 0 and at and a[at - 1] == b[p.open_b]:
            # The piece before has this overlap already; here a group closes.
            p = p._replace(a=p.a[1:], b=p.b[1:], closed_a=np.append(at - 1, p.closed_a),
                           closed_b=np.append(p.open_b, p.closed_b))
        stitched.append(p)
    return tuple(np.concatenate([getattr(p, f) for p in stitched])
                 for f in ("a", "b", "closed_a", "closed_b"))


def written_groups(pair: Pair, a: np.ndarray, b: np.ndarray, closed_a: np.ndarray,
                   closed_b: np.ndarray) -> list[str]:
    """All ids in order, with what follows each: ``,``, ``|`` or ``;``."""
    ends_a = np.zeros(len(a), bool)
    ends_b = np.zeros(len(b), bool)
    ends_a[closed_a] = True
    ends_b[closed_b] = True
    group_a = np.cumsum(ends_a) - ends_a     # groups before each token
    group_b = np.cumsum(ends_b) - ends_b
    before = np.append(0, closed_b + 1)      # B tokens before each group
    after = np.append(closed_a + 1, len(a))  # A tokens up to each group's end
    place_a = np.arange(len(a)) + before[group_a]
    place_b = np.arange(len(b)) + after[group_b]
    out = np.empty(len(a) + len(b), object)
    comma = pair.written[","]
    out[place_a] = np.where(ends_a, pair.written["|"][a], comma[a])
    out[place_b] = np.where(ends_b, pair.written[";"][b], comma[b])
    return out.tolist()


def aligned(pair: Pair, texts: list[str], piece: int = PIECE) -> list[pa.Array]:
    """The output columns for ``texts``."""
    a, b = pair.encode(texts)
    docs = len(texts)
    ends_a, ends_b = np.cumsum(pair.a_size[a.ids]), np.cumsum(pair.b_size[b.ids])
    link_a, link_b, closed_a, closed_b = merge(ends_a, ends_b, piece)
    # Texts end with both lists, so each overlap and group lies in one text.
    link_at = np.searchsorted(link_a, a.starts, "left")
    group_at = np.searchsorted(closed_a, a.starts, "left")
    items = written_groups(pair, a.ids, b.ids, closed_a, closed_b)
    starts = (a.starts + b.starts).tolist()
    groups = ["".join(items[s:e])[:-1] for s, e in pairwise(starts)]
    text_of = np.repeat(np.arange(docs), np.diff(link_at))
    key = ((text_of << 2 * ID_BITS) | (a.ids[link_a].astype(np.int64) << ID_BITS)
           | b.ids[link_b])
    distinct, times = np.unique(key, return_counts=True)
    offsets = np.searchsorted(distinct >> 2 * ID_BITS, np.arange(docs + 1), "left")
    mask = (1 << ID_BITS) - 1
    linked = pa.StructArray.from_arrays(
        [pa.array((distinct >> ID_BITS & mask).astype(np.int32)),
         pa.array((distinct & mask).astype(np.int32)), pa.array(times.astype(np.int64))],
        names=["a", "b", "n"])
    return [pa.array(np.diff(x)) for x in (a.starts, b.starts, group_at, link_at)] + [
        pa.array(groups, pa.string()),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), linked)]


def blocks(texts: list[str], size: int = BLOCK_BYTES) -> Iterator[slice]:
    """Runs of texts of about ``size`` characters; a longer text is its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def load(a_file: bytes, b_file: bytes) -> Pair:
    """Both tokenizers, built once per Python worker."""
    key = zlib.crc32(a_file), zlib.crc32(b_file)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(a_file, b_file)
    return _LOADED[key]


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text",
          piece: int = PIECE) -> DataFrame:
    """``df`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, the groups as
    ``a1,a2|b1;a3|b2,b3`` and the distinct ``links`` (a, b, n)."""
    spark = df.sparkSession
    df = cleared(df, OUTPUTS, [text])
    python_ready(spark)
    a_file, b_file = share(spark, a_path), share(spark, b_path)
    kinds = ("long",) * 4 + ("string", "array<struct<a:int,b:int,n:bigint>>")
    schema = df.select("*", *[F.lit(None).cast(k).alias(c)
                              for c, k in zip(OUTPUTS, kinds, strict=True)]).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(a_file.value, b_file.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for part in blocks(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *aligned(pair, texts[part], piece)],
                    [*rows.schema.names, *OUTPUTS])

    return map_batches(df, run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked pair; ``best``: no A id has more
    links to this B id."""
    linked = rows.select(F.explode("links").alias("l")).select("l.*")
    counts = linked.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = staged(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return staged(counts.join(most, "b").select(
        "a", "b", "count", (F.col("count") == F.col("_most")).alias("best")), "pair-bests")


def scored(rows: DataFrame) -> DataFrame:
    """``rows`` (written rows of ``align``) with ``n_best`` and ``count_sum``
    in place of ``links``; ``_row`` tells them apart."""
    counts, _, _ = bounded_broadcast(pair_counts(rows))
    each = rows.select("_row", F.explode("links").alias("l")).select("_row", "l.*")
    sums = each.join(counts, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("links").join(sums, "_row", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}).drop("_row")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written down with a number each, ``_row``."""
    return staged(rows.drop("_row").withColumn("_row", F.monotonically_increasing_id()), name)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both tokenizers aligned and counted."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", whole_text().alias("text"))
    rows = align(docs, public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(
        F.sha2(F.col("groups").cast("binary"), 256))
    narrow = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "links",
                         digest.alias("groups_sha256"))
    return scored(numbered(narrow, "aligned")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
