import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import quarry.llm.cotraining as C
import quarry.llm.packing as K
from quarry.llm.common import staged, table
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows

LABELS = "doc_id long, quality int, toxic int"


def test_logistic_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    view = C.calibrate(C.fit(x, y), x, y)
    p = C.sigmoid(view.log_odds(x))
    assert ((p > 0.5) == (y > 0)).mean() > 0.9 and abs(p.mean() - y.mean()) < 0.05


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600).astype(float)
    a = np.stack([y + 0.4 * rng.normal(size=600), rng.normal(size=600)], axis=1)
    b = np.stack([y + 0.4 * rng.normal(size=600)] + [rng.normal(size=600)] * 2, axis=1)
    few = slice(0, 24)
    got = C.co_train({}, a[few], b[few], y[few], lambda h: C.pool_sums(h, (a[100:], b[100:])))
    alone = C.co_train({}, a[few], b[few], y[few], None)

    def right(m):
        odds = m.text.log_odds(a[100:]) + m.meta.log_odds(b[100:]) - m.prior
        return ((odds > 0) == (y[100:] > 0)).mean()

    assert right(got) > 0.9 and right(got) >= right(alone) - 0.02


def test_sums_of_all_unlabelled_rows(spark):
    """The pass in Spark gives the sums of every row, whatever the partitions."""
    docs = table(spark, SF_SMALL, "documents").select(
        "doc_id", "text", "source", "lang", "n_chars", F.lit(None).cast("double").alias("y"))
    words = {"the": 0, "la": 1, "und": 2}
    written = staged(C.features(docs.repartition(5), words), "features")
    views = C.view_rows(words, written.toPandas().replace({np.nan: None}).to_dict("list"))
    rng = np.random.default_rng(3)
    history = [tuple(C.calibrate(C.fit(x, y), x, y) for x in views)
               for y in (rng.integers(0, 2, 200).astype(float) for _ in range(2))]
    want = C.pool_sums(history, views)
    assert C.spark_pool(written, words)(history) == pytest.approx(want, rel=1e-9, abs=1e-9)
    sums = C.unflat(want, history)
    p = C.sigmoid(history[0][1].log_odds(views[1]))
    assert sum(s.n for s in sums[0]) >= ((p >= C.CONFIDENT) | (p <= 1 - C.CONFIDENT)).sum()
    none = C.spark_pool(written.limit(0), words)(history)
    assert none.shape == want.shape and not none.any()


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, SF_MID, t) for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(4)) == 0
    model = C.train(docs, labels.where(~test))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = C.score(docs.join(labels.where(test), "doc_id"), model).select(good.alias("y"), "kept").collect()
    clean = [r.kept for r in rows if r.y]
    bad = [r.kept for r in rows if not r.y]
    assert sum(clean) >= 0.95 * len(clean) and sum(bad) <= 0.3 * len(bad)


def test_classifier_on_odd_rows(spark):
    df = documents(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, None), (4, None, 1),
                                    (None, 1, 1), (5, 0, 1), (5, 1, 0)], LABELS)
    model = C.train(df, labels)
    got = C.score(clashing(df, "kept", "P_good"), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.p_good <= 1 for r in got)
    assert len({r.p_good for r in got if r.doc_id == 3}) == 1
    one_kind = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], LABELS)
    assert C.train(df, one_kind) is None
    assert C.score(df, None).where("kept").count() == len(odd_rows())
    empty = documents(spark, [])
    assert C.train(empty, labels) is None and C.score(empty, model).count() == 0


@pytest.mark.parametrize("frequent", [2, 1000])
def test_every_item_goes_to_a_tightest_compatible_bin(monkeypatch, frequent):
    monkeypatch.setattr(K, "FREQUENT", frequent)
    rng = random.Random(frequent)
    for _ in range(150):
        n = rng.randint(0, 60)
        lengths = sorted((rng.randint(0, 40) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "a", "b", "c", "d"]) for _ in lengths]
        clusters = [rng.randint(0, 15) for _ in lengths]
        placed, used = K.pack_items(lengths, sources, clusters, 50)
        fill, inside = {}, defaultdict(set)
        for size, s, c, (b, offset) in zip(lengths, sources, clusters, placed, strict=True):
            marks = {("c", c)} | ({("s", s)} if s is not None else set())
            fits = [50 - fill[x] for x in fill if 50 - fill[x] >= size and not marks & inside[x]]
            assert offset == fill.get(b, 0) and not marks & inside[b]
            assert (b not in fill) if not fits else 50 - fill[b] == min(fits)
            fill[b] = offset + size
            inside[b] |= marks
        assert [fill[i] for i in range(len(used))] == used


def test_packing_odd_rows_and_long_texts(spark):
    docs = clashing(documents(spark, odd_rows()), "piece", "bin_id", "length")
    got = K.pack(K.measured(docs), capacity=1000, shard_items=4).collect()
    total = defaultdict(int)
    for r in got:
        total[r.doc_id, r.cluster] += r.length
        assert r.bin_offset + r.length <= r.bin_used <= 1000
    assert sum(total.values()) == sum(len(r[1] or "") for r in odd_rows())
    five = sorted((r.start, r.length) for r in got if r.doc_id == 5)
    assert five == [(i * 1000, 1000) for i in range(150)]
    for b in {r.bin_id for r in got}:
        inside = [r for r in got if r.bin_id == b]
        sources = [r.source for r in inside if r.source is not None]
        assert len(set(sources)) == len(sources)
        assert len({r.cluster for r in inside}) == len(inside)
    assert K.pack(K.measured(documents(spark, []))).count() == 0


def replayed(rows, capacity):
    """Each piece in packing order: its bin was the tightest compatible one."""
    bins = defaultdict(lambda: (capacity, set(), set()))
    for r in rows:
        size, s, c = r["length"], r["source"], r["cluster"]
        fits = {b: left for b, (left, ss, cs) in bins.items()
                if left >= size and (s is None or s not in ss) and (c is None or c not in cs)}
        left, ss, cs = bins[r["bin_id"]] if r["bin_id"] in bins else (capacity, set(), set())
        assert r["bin_offset"] == capacity - left
        if r["bin_id"] in bins:
            assert r["bin_id"] in fits and left == min(fits.values())
        else:
            assert not fits
        bins[r["bin_id"]] = (left - size, ss | {s}, cs | {c})
    assert all(r["bin_used"] == capacity - bins[r["bin_id"]][0] for r in rows)


def test_query_over_the_whole_table(spark):
    got = K.op8_packing(spark, SF_SMALL)
    assert got.columns == [f.split()[0] for f in K.SCHEMA.split(", ")]
    order = got.withColumn("item", F.xxhash64("doc_id", "piece", "cluster")).orderBy(
        F.col("length").desc(), "item", "start").collect()
    replayed([r for r in order if r["length"] < K.CAPACITY], K.CAPACITY)
    docs = table(spark, SF_SMALL, "documents")
    lengths = {r["doc_id"]: len(r["text"] or "") for r in docs.collect()}
    found = defaultdict(list)
    for r in order:
        found[r["doc_id"]].append((r["start"], r["length"]))
    assert set(found) == set(lengths)
    for doc_id, parts in found.items():
        ends = [0]
        for start, n in sorted(parts):
            assert start == ends[-1]
            ends.append(start + n)
        assert ends[-1] == lengths[doc_id]
    from quarry.llm.simhash import near_duplicates
    groups = {r["doc_id"]: r["root"] for r in near_duplicates(docs).collect()}
    assert all(r["cluster"] == groups[r["doc_id"]] for r in order)
    assert len(set(groups.values())) < len(groups)


def test_shards_follow_the_pieces(spark):
    rows = [(i, 100_000 if i == 0 else 5, None, i) for i in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")
    got = K.pack(df, capacity=10, shard_items=1000).collect()
    shards = defaultdict(int)
    for r in got:
        shards[r["bin_id"] >> 32] += 1
    assert len(got) == 10_010 and len(shards) == 11 and max(shards.values()) < 1300


def test_hot_source_and_cluster_stay_fast():
    import time

    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 9000) for _ in range(6000)), reverse=True)
    sources = [rng.choice("abcdefghij") if i % 3 else "hot" for i in range(6000)]
    clusters = [7 if i % 3 == 1 else 1000 + i for i in range(6000)]
    began = time.perf_counter()
    K.pack_items(lengths, sources, clusters, 16_384)
    assert time.perf_counter() - began < 20


def test_pipeline_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    more = docs.withColumns({"kept": F.lit(1), "_others": F.lit("x"), "a.b": F.lit(3)})
    more = more.union(more.limit(3)).union(more.limit(2).withColumn("text", F.lit(None).cast("string")))
    more = more.union(more.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    rows, counts = staged(more, "pipeline-test"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, rows, SF_SMALL), name)
        assert out.columns == more.columns
        assert out.where("n_chars <> length(text)").count() == 0
        counts[name] = (rows.count(), out.count())
        rows = out
    assert counts["quality_classifier"][0] > counts["quality_classifier"][1] > 100
    assert counts["simhash_near_dedup"][0] > counts["simhash_near_dedup"][1]
    for name in ("suffix_array_dedup", "secret_scans"):
        assert counts[name][0] == counts[name][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF_SMALL)
    assert packed.agg(F.sum("length")).first() == rows.agg(F.sum("n_chars")).first()


def test_pipeline_of_nothing(spark):
    rows = table(spark, SF_SMALL, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        rows = staged(stage(spark, rows, SF_SMALL), name)
        assert rows.count() == 0


def test_pipeline_run_keeps_one_of_each_group(spark):
    import quarry.llm.simhash as H

    docs = table(spark, SF_SMALL, "documents")
    one = corpus_pipeline.simhash_near_dedup(spark, docs, SF_SMALL)
    found = H.near_duplicates(docs)
    roots = found.select("component_id").distinct()
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in roots.collect()}
