import hashlib
import random

import numpy as np

from quarry.llm.iblt import (compare_versions, differences, digests, edited, fingerprints,
                             likeness, op2_fingerprints, paragraphs)
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows


def test_paragraphs_keep_all_words():
    t = "One. Two two!\nThree? " + "x" * 600 + "\n\n 4.5 five."
    assert "".join("".join(paragraphs(t)).split()) == "".join(t.split())
    assert "One." in paragraphs(t) and max(map(len, paragraphs(t))) <= 257
    assert paragraphs("") == [] == paragraphs(" \n ")


def test_differences_are_exact_at_any_size():
    rng = random.Random(3)
    a, b, want = [], [], []
    for n in (0, 1, 5, 30, 200, 1500):
        for shared in (0, 3, 400):
            x, y, z = ({rng.getrandbits(64) for _ in range(k)} for k in (n, n // 2, shared))
            a.append(np.array(sorted(x | z), np.uint64))
            b.append(np.array(sorted(y | z), np.uint64))
            want.append((x, y))
    assert differences(a, b) == want
    assert fingerprints(a) == fingerprints([x.copy() for x in a])


def test_copies_of_a_paragraph_count():
    a, b = digests("Same. Same. Same."), digests("Same.")
    assert len(a) == 3 and likeness([a], [b]) == [1 / 3]
    assert likeness([digests("")], [digests("")]) == [1.0]


def test_edited():
    assert edited("abcde", "XYZ") == "abcXY" and edited("abcdef", "X") == "abcX"
    assert edited("a", "XY") == "a" and edited("", "XY") == ""


def check(rows, got):
    def jaccard(x, y):
        x, y = set(digests(x).tolist()), set(digests(y).tolist())
        return len(x & y) / len(x | y) if x | y else 1.0

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, row in enumerate(order):
        t, f = row[1] or "", order[(i + 1) % len(order)][1] or ""
        e = edited(t, f)
        want.append((row[0], len(t), hashlib.sha256(e.encode()).hexdigest(),
                     round(jaccard(t, e), 9), round(jaccard(t, f), 9)))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
             for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_odd_rows_in_many_ranges(spark):
    rows = odd_rows()
    df = clashing(documents(spark, rows), "fingerprint", "part", "guest")
    for size in (1, 1000, 1 << 30):
        got = compare_versions(df, range_bytes=size).collect()
        check([(r[0], r[1]) for r in rows], got)
    same = {r.fingerprint for r in got if r.doc_id == 3}
    assert len(same) == 1
    assert compare_versions(documents(spark, [])).count() == 0
    one = compare_versions(documents(spark, [(9, "a b. c", "en", "a", 6)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_op2_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    check([(d.doc_id, d.text) for d in docs], op2_fingerprints(spark, SF_SMALL).collect())
