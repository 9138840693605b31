import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quarry.llm.alignment import (Pair, align, aligned, blocks, chunks, diagonals, merge,
                                  numbered, op11_alignment, scored)
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    with open(A, "rb") as a, open(B, "rb") as b:
        return Pair(a.read(), b.read())


def letters():
    """The byte-level letters, by the public rule, kept apart from the module's."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_tokens(text):
    """[(id, start, end)] of A and B from the libraries, over the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    table = letters()
    if not text:
        return [], []
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_parts = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
    b_parts = []
    for i in b_ids:
        p = b.id_to_piece(i)
        b_parts.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
        return [], []

    def placed(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    return placed(a_ids, a_parts), placed(b_ids, b_parts)


def brute(a, b):
    """Links (every pair of tokens compared where small) and the group string."""
    links, j0 = [], 0
    for i, s, e in a:
        while j0 < len(b) and b[j0][2] <= s:
            j0 += 1
        j = j0
        while j < len(b) and b[j][1] < e:
            if min(e, b[j][2]) > max(s, b[j][1]):
                links.append((i, b[j][0]))
            j += 1
    both = sorted({x[2] for x in a} & {x[2] for x in b})
    groups, start = [], 0
    for end in both:
        groups.append("|".join(",".join(str(x[0]) for x in side if start <= x[1] < end)
                               for side in (a, b)))
        start = end
    return links, groups


CASES = ["", "a", " ", "  two  spaces ", "tab\tand\nline\n\n", "<|endoftext|> <s> </s> <0x41>",
         "naïve café 漢字 😀😀 ﷺ", "under ▁ score", "x" * 3000, "don't we'll 12345 67 8",
         "ends with space ", " nbsp em", "a\x00b", "İstanbul ΑΣ", "é é"]


def test_against_the_libraries_and_every_pair(pair):
    cases = CASES + texts(3, 30)
    for piece in (1 << 14, 64, 3, 1):
        columns = [c.to_pylist() for c in aligned(pair, cases, piece)]
        for text, *got in zip(cases, *columns):
            a, b = brute_tokens(text)
            links, groups = brute(a, b)
            found = sorted((x["a"], x["b"], x["n"]) for x in got[5])
            assert got[:5] == [len(a), len(b), len(groups), len(links), ";".join(groups)], text
            assert found == sorted((*k, n) for k, n in Counter(links).items()), text


def test_both_coders_of_a_agree(pair):
    rng = random.Random(6)
    stable = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC)]
    bits = ["'s", "'re", " ", "  ", "\n\n", "12", "<|endoftext|>", "the", "ing", "\x85", "\xa0"]
    cases = ["".join(rng.choice(stable if rng.random() < 0.5 else bits)
                     for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    cases += [f"a{c}b {c} 1{c}" for c in stable]
    library = [e.ids for e in pair.a.encode_batch(cases, add_special_tokens=False)]
    assert pair.ranked and [pair.ranked.encode_ordinary(c) for c in cases] == library
    assert pair.encode_a(cases + ["漢 ʰ"])[:-1] == library


def test_merge_of_random_ends():
    rng = np.random.default_rng(4)
    for _ in range(300):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 40)), total))
                for _ in range(2)]
        edges = np.union1d(*ends)
        expected = [(int(np.searchsorted(ends[0], e)), int(np.searchsorted(ends[1], e)))
                    for e in edges]
        closed = [(int(np.searchsorted(ends[0], e)), int(np.searchsorted(ends[1], e)))
                  for e in np.intersect1d(*ends)]
        for piece in (1, 2, 7, 1000):
            a, b, x, y = (v.tolist() for v in merge(*ends, piece))
            assert list(zip(a, b)) == expected and list(zip(x, y)) == closed
            cuts = diagonals(*ends, piece)
            work = np.diff(cuts.sum(1))
            assert (work[:-1] == piece).all() and (np.diff(cuts, axis=0) >= 0).all()


def test_long_texts_are_cut_where_nothing_changes(pair, monkeypatch):
    rng = random.Random(8)
    words = ["alpha", "  b", "\n", "c\t", "don't", "é", " ", "", "12", "漢", "z" * 40, "."]
    cases = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    whole = [c.to_pylist() for c in aligned(pair, cases)]
    for size in (1, 5, 30):
        monkeypatch.setattr(pair, "part", size)
        assert [c.to_pylist() for c in aligned(pair, cases)] == whole
        assert all(" ".join(chunks(c, size)) == c for c in cases)


def test_blocks_cover_all_texts():
    for seed in range(20):
        rng = random.Random(seed)
        rows = ["x" * rng.choice([0, 1, 5, 50]) for _ in range(rng.randint(0, 30))]
        got = [i for s in blocks(rows, 20) for i in range(s.start, s.stop)]
        assert got == list(range(len(rows)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_over_the_corpus(spark, monkeypatch, broadcast):
    if not broadcast:   # as for more pairs than a broadcast may hold
        monkeypatch.setattr("quarry.llm.alignment.bounded_broadcast", lambda df: (df, 0, False))
    rows = documents(spark, odd_rows() + [(20 + i, t, "en", "a", 1)
                                          for i, t in enumerate(texts(5, 40))])
    frame = clashing(rows, "links", "n_a", "groups")
    out = numbered(align(frame, A, B, piece=50), "aligned")
    assert "a.b" in out.columns
    links = {}
    for r in out.collect():
        links[r["_row"]] = brute(*brute_tokens(r["text"]))[0]
    count = Counter(x for v in links.values() for x in v)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    expected = sorted((len(v), sum(count[x] == most[x[1]] for x in v), sum(count[x] for x in v))
                      for v in links.values())
    got = scored(out)
    assert sorted(tuple(r) for r in got.select("n_links", "n_best", "count_sum").collect()) == expected
    empty = scored(numbered(align(frame.limit(0), A, B), "aligned"))
    assert empty.count() == 0


def test_query_over_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text").collect()}
    links, rest = {}, {}
    for doc_id, text in docs.items():
        a, b = brute_tokens(text)
        links[doc_id], groups = brute(a, b)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rest[doc_id] = (len(a), len(b), len(groups), len(links[doc_id])), digest
    count = Counter(x for v in links.values() for x in v)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    got = op11_alignment(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        v = links[r["doc_id"]]
        assert tuple(r)[1:] == (*rest[r["doc_id"]][0], sum(count[x] == most[x[1]] for x in v),
                                sum(count[x] for x in v), rest[r["doc_id"]][1])
    assert [f.dataType.simpleString() for f in op11_alignment(spark, SF_SMALL).schema][1:7] == [
        "bigint"] * 6
