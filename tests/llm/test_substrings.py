import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import quarry.llm.substrings as S
from quarry.llm.deepshallow import BlindTrie, common_prefix, sort, sort_with_prefixes
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows, texts


def brute(rows):
    """{doc_id: (bytes, kept, spans)} for rows with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for s in range(len(b) - S.WINDOW + 1):
            w = b[s:s + S.WINDOW]
            if w in seen:
                mask[s:s + S.WINDOW] = b"\1" * S.WINDOW
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        out[i] = (len(b), bytes(c for c, m in zip(b, mask) if not m), spans)
    return out


def compared(rows, got):
    want = brute(rows)
    found = {r.doc_id: (len((r.text or "").encode()), bytes(r.kept), len(r.removed)) for r in got}
    assert found == want


def test_deep_shallow_sorts_like_sorted():
    rng = random.Random(1)
    for alphabet in (b"ab", bytes(range(256))):
        for _ in range(150):
            xs = [bytes(rng.choices(alphabet, k=rng.randint(0, 70))) for _ in range(rng.randint(1, 25))]
            xs += [xs[0] + b"a" * rng.randint(0, 60) for _ in range(4)] + [xs[0]]
            order, before = sort_with_prefixes(xs)
            assert [xs[i] for i in order] == sorted(xs)
            for a, b, n in zip(order, order[1:], before[1:]):
                assert xs[a][:n] == xs[b][:n] and xs[a][n:n + 1] != xs[b][n:n + 1] or n == min(
                    len(xs[a]), len(xs[b]))
            assert [xs[i] for i in sort(xs, shallow=0)] == sorted(xs)


def test_blind_trie_with_ends_and_copies():
    xs = [b"abc", b"ab", b"abc", b"", b"abd", b"b"]
    trie = BlindTrie(xs)
    for i in range(len(xs)):
        trie.insert(i)
    assert [xs[i] for i in trie.ordered()] == sorted(xs)
    assert common_prefix(b"abcx", b"abcy") == 3 and common_prefix(b"", b"a") == 0


def test_anchors_cover_each_window_once_and_depend_on_its_bytes(monkeypatch):
    column = pa.array(["ab" * 300, "x" * 99, None, "", *texts(3, 20)])

    def windows():
        out = {}
        for data, ends, rows, offsets in S.blocks(column):
            gram, place, first, last = S.anchors(data, ends)
            part = np.searchsorted(ends, place, side="right")
            start = np.concatenate([[0], ends[:-1]])[part]
            for r, o, a, b, p in zip(rows[part], offsets[part], first - start, last - start,
                                     place - start, strict=True):
                for s in range(a, b + 1):
                    assert (r, o + s) not in out
                    out[r, o + s] = p - s
        return out

    whole = windows()
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)
    assert windows() == whole
    sizes = [len((t or "").encode()) for t in column.to_pylist()]
    assert len(whole) == sum(max(0, n - S.WINDOW + 1) for n in sizes)
    by_bytes = {}
    for (r, s), distance in whole.items():
        w = column[int(r)].as_py().encode()[s:s + S.WINDOW]
        assert by_bytes.setdefault(w, distance) == distance


def test_filter_misses_nothing(spark):
    rng = np.random.default_rng(0)
    grams = rng.integers(-2**63, 2**63 - 1, 3000)
    table = S.bloom_filter(spark.createDataFrame([(int(g),) for g in grams], "gram long"))
    assert S.maybe_in(table, grams.view(np.uint64)).all()
    assert S.maybe_in(table, rng.integers(0, 2**63, 3000).astype(np.uint64)).mean() < 0.2


@pytest.mark.parametrize("hot", [4096, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = list(enumerate(texts(hot)))
    rows += [(100, None), (101, ""), (102, "ab" * 400), (103, "a" * 5000), (104, "ab" * 300 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compared(rows, S.remove_repeats(clashing(df, "kept", "removed")).collect())


def test_odd_rows(spark):
    got = S.remove_repeats(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    kept = {(r.doc_id, r.text): bytes(r.kept) for r in got}
    assert kept[5, "word " * 30_000] == b"word "
    long = "z" + "some long text of its own " * 3 + "end of it, after more than 100 bytes " * 2
    same = S.remove_repeats(documents(spark, [(1, long, "en", "a", 0)] * 2)).collect()
    assert [bytes(r.kept) for r in same] == [long.encode()] * 2
    again = S.remove_repeats(documents(spark, [(1, long, "", "", 0), (2, "é" + long, "", "", 0)]),
                             as_text=True).collect()
    assert {r.doc_id: r.kept for r in again} == {1: long, 2: "é"}
    assert S.remove_repeats(documents(spark, [])).count() == 0


def test_op3_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = brute([(d.doc_id, d.text) for d in docs])
    got = S.op3_suffix_dedup(spark, SF_SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        n, kept, spans = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())
