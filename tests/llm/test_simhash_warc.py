import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

import quarry.llm.simhash as H
import quarry.llm.warc as A
from quarry.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows


def brute_print(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, differ=4):
    values = np.array(prints, np.uint64)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= differ)[0]:
            a, b = sorted((find(i), find(i + 1 + int(j))))
            parent[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    for t in ("", " \n", "One", "a B c", "A b\x0bC d É e f", "x\x85y \xa0 z q r", "w " * 500):
        assert H.fingerprint(t) == brute_print(t), t


@pytest.mark.parametrize("blocks", [6, 7, 8, 9, 10])
def test_blocks_miss_no_pair(blocks):
    rng = random.Random(blocks)
    masks = H.block_masks(blocks, 4)
    for _ in range(200):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flip & (m % (1 << 64)) for m in masks)
    assert H.choose_blocks(1, 4) == 6 and H.choose_blocks(10**12, 4) == 10


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_have_the_components_of_all_pairs(spark, bucket):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):   # clusters, chains and strangers
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            prints.add(p)
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    prints = sorted(prints | {0, (1 << 64) - 1, 7})
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    stars = {r.node: r.root for r in H.components(H.near_links(df, bucket=bucket)).collect()}
    roots = [stars.get(s, s) for s in signed]
    want = brute_components(prints)
    assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want))


def test_no_join_is_broadcast(spark):
    """Spark takes the exploded keys for as small as the fingerprints' files."""
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 62),) for i in range(50)],
                                   "fp long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    docs = documents(spark, odd_rows())
    for df in (H.near_links(prints), H.large_star(edges), H.small_star(edges),
               H.near_duplicates(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in H.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_odd_rows_and_keepers(spark):
    rows = odd_rows()
    found = H.near_duplicates(clashing(documents(spark, rows), "fp", "component_id"))
    got = found.collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text_hash): r for r in got}
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {1} and len(by) == len(rows) - 1
    same = {r.component_id for r in got if r.doc_id == 3}
    assert same == {3}
    kept = H.keepers(found).collect()
    assert len(kept) == len({r.root for r in got})
    assert H.near_duplicates(documents(spark, [])).count() == 0


def test_op6_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in H.op6_simhash(spark, SF_SMALL).collect()}
    prints = [brute_print(d.text) for d in docs]
    roots = brute_components(prints)
    for d, p, r in zip(docs, prints, roots, strict=True):
        assert rows[d.doc_id].fingerprint == f"{p:016x}"
        assert rows[d.doc_id].component_id == docs[r].doc_id


def test_loser_tree_merges_any_runs():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 7))) for _ in range(k)]
        assert list(A.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


PAGES = "page_id long, url string, html string"
ODD = [(3, "http://a.b/x", "hi\r\n\r\nWARC/1.1\r\n"), (1, None, "hi\r\n\r\nWARC/1.1\r\n"),
       (2, "http://a.b/x\n%0A", None), (None, "u", "q"), (5, "u", ""), (5, "u", "q"),
       (3, "http://a.b/x", "hi\r\n\r\nWARC/1.1\r\n"), (7, "HTTP://Z.y:8/é", "é" * 70_000)]


def test_archives_round_trip(spark):
    path = scratch_path(spark, "warc-test")
    pages = clashing(spark.createDataFrame(ODD, PAGES), "digest", "payload", "revisit")
    A.write_archives(pages, path, shard_bytes=20_000)
    merged = A.merge_runs(A.read_captures(spark, path), range_rows=3)
    rows = merged.collect()
    keys = [(r.url_key is not None, r.url_key or "", r.timestamp, r.page_id or -1) for r in rows]
    assert keys == sorted(keys) and merged.rdd.getNumPartitions() > 1
    assert sorted(str((r.page_id, r.url)) for r in rows) == sorted(str(x[:2]) for x in ODD)
    for r in rows:
        group = [i for i, _, h in ODD if base64.b32encode(
            hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest]
        first = min(i for i in group if i is not None)
        assert (r.record_type == "revisit") == (r.page_id != first)
        assert r.refers_to == (first if r.page_id != first else None)
    path = scratch_path(spark, "warc-min")
    A.write_archives(spark.createDataFrame(ODD, PAGES), path, min_bytes=1)
    empty = [r for r in A.read_captures(spark, path).collect() if not r.payload_bytes]
    assert {r.record_type for r in empty} == {"response"}


def test_urls_are_written_as_they_are():
    for url in ("http://a.b/x%20y%0A", "a%25b", "", "u "):
        headers = next(A.parse(A.record(1, url, b"", None, False) + A.CLOSE.encode()))[2]
        assert headers["WARC-Target-URI"] == url and "X-Target-URI-Escaped" not in headers
    headers = next(A.parse(A.record(1, "a\n%0A", b"", None, False) + A.CLOSE.encode()))[2]
    assert A.unescaped(headers["WARC-Target-URI"]) == "a\n%0A" and "X-Target-URI-Escaped" in headers
    assert A.timestamp(10**9 + 1) > A.timestamp(10**9) > A.timestamp(5)


def test_archive_of_nothing_and_damage(spark):
    path = scratch_path(spark, "warc-empty")
    A.write_archives(spark.createDataFrame([], PAGES), path)
    assert A.merge_runs(A.read_captures(spark, path)).count() == 0
    good = A.record(1, "u", b"abc", None, False) + A.CLOSE.encode()
    assert [b for *_, b in A.parse(good + good)] == [b"abc"] * 2
    for bad in (good[1:], good[:-1], good.replace(b"Length: 3\r", b"Length: 2\r")):
        with pytest.raises(ValueError):
            list(A.parse(bad))


def test_op9_sql_agrees(spark):
    got = A.op9_warc(spark, SF_SMALL).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {cols} FROM ({A.OP9_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
