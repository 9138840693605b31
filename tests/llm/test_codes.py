import hashlib
import random

import numpy as np
import pytest

from quarry.llm.codes import (Codebooks, State, assign, compress, net_displacements,
                              op12_vector_codes, replaced, sums_of, with_label_error)
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Whole-number k-means by the definition, in Python integers."""
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v], lab, v)
            for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    if not kept:
        return [], []
    d = len(kept[0][1])
    cuts = [d * i // parts for i in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(cuts, cuts[1:])] for _, v, _, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def place(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [place(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, x in zip(cut, chosen) if x == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    out = []
    for (i, _, lab, _), c in zip(kept, cut):
        best = [place(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best), lab))
    return out, books


def vectors(seed, n, d=16, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(5)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [x + rng.gauss(0, spread) * rng.choice([0, 1]) for x in c],
                    rng.choice([None, 1, 2, 3])))
    return out


def flat(books):
    return ",".join(str(x) for book in books for e in book for x in e)


@pytest.mark.parametrize("n,d,entries", [(200, 16, 16), (60, 13, 4), (5, 8, 16), (40, 3, 1)])
def test_against_python_integers(spark, n, d, entries):
    rows = vectors(n + d, n, d)
    rows += [(None, rows[0][1], 1), (1, rows[2][1], 2), (2, rows[2][1], 2), (900, None, 1),
             (901, [float("nan")] * d, 1), (902, [None] * d, 2), (903, [float("inf")] * d, 3)]
    random.Random(1).shuffle(rows)
    frame = clashing(spark.createDataFrame(rows, SCHEMA), "code", "error").repartition(7)
    got, model = compress(frame, entries=entries)
    expected, books = brute(rows, entries=entries)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in got.collect()),
                  key=repr) == sorted(expected, key=repr)
    assert model.digest() == hashlib.sha256(flat(books).encode()).hexdigest()
    assert "a.b" in got.columns and "embedding" not in got.columns


def test_bounds_skip_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 16)) * 300 + rng.integers(0, 4, (3000, 1)) * 4000).astype(np.int64)
    cuts = [0, 8, 16]
    start = [x[:16, :8].copy(), x[:16, 8:].copy()]
    model, state = Codebooks(cuts, "<i8", [start]), State.new(len(x), 2)
    for r in range(7):
        errors, scans = assign(x, model, state, r == 0)
        plain = State.new(len(x), 2)
        alone = Codebooks(cuts, "<i8", [model.history[-1]])
        exact, _ = assign(x, alone, plain, True)
        assert (errors == exact).all() and (state.assigned == plain.assigned).all()
        model.scans.append(scans)
        model.history.append(replaced(model, sums_of(x, model, state)))
    assert model.scans[0] == 6000 and min(model.scans[1:]) < 4000


def test_net_displacement_is_no_more_than_the_drifts():
    rng = np.random.default_rng(3)
    books = [[rng.integers(-500, 500, (4, 6))] for _ in range(5)]
    net = net_displacements(books, 0)
    assert (net[-1] == 0).all()
    for t in range(5):
        drift = sum(np.sqrt(((books[s + 1][0] - books[s][0]) ** 2).sum(1)) for s in range(t, 4)) \
            if t < 4 else np.zeros(4)
        for a in range(4):
            others = np.delete(drift, a)
            assert net[t, a] <= others.max() * (1 + 1e-6)


def test_ties_take_the_lower_index(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(20)]
    got, _ = compress(spark.createDataFrame(rows, SCHEMA))
    assert {r["code"] for r in got.collect()} == {"00" * 8, "01" * 8}


def test_empty_and_refused_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    got, model = compress(none)
    assert model is None and got.count() == 0 and got.columns == ["vec_id", "label", "code", "error"]
    assert with_label_error(got).count() == 0
    only_null, model = compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert model is None and only_null.count() == 0
    blank, _ = compress(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA))
    assert sorted(tuple(r)[2:] for r in blank.collect()) == [("00" * 8, 0), ("00" * 8, 0)]
    for bad in ([[1.0], [1.0, 2.0]], [[3e38], [1.0]]):
        with pytest.raises(ValueError):
            compress(spark.createDataFrame([(i, v, 0) for i, v in enumerate(bad)], SCHEMA))


def test_label_errors_by_broadcast_and_by_join(spark):
    rows = [(i, None if i % 3 == 0 else i % 50 + 1 if i % 3 == 1 else 7, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, error long")
    want = {}
    for _, lab, e in rows:
        want[lab] = want.get(lab, 0) + e
    for limit in (1000, 2):
        got = with_label_error(frame, limit=limit)
        assert got.columns == ["vec_id", "label", "error", "label_error"]
        assert sorted((r["vec_id"], r["label_error"]) for r in got.collect()) == [
            (i, want[lab]) for i, lab, _ in rows]


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
            .select("vec_id", "embedding", "label").collect()]
    expected, books = brute(rows)
    digest = hashlib.sha256(flat(books).encode()).hexdigest()
    by_label = {}
    for _, _, e, lab in expected:
        by_label[lab] = by_label.get(lab, 0) + e
    got = op12_vector_codes(spark, SF_SMALL).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (i, c, e, by_label[lab], digest) for i, c, e, lab in expected)
