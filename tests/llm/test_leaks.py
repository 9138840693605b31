import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm.leaks import decontaminate, find, op13_decontamination
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, window=10):
    """{(id, text): (n_words, hit positions, item ids)} by comparing every window."""
    found = {}
    for doc_id, text in docs:
        ws, hit, ids = word_list(text), set(), set()
        for item_id, item in items:
            iw = word_list(item)
            n = min(len(iw), window)
            wanted = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            at = [i for i in range(len(ws) - n + 1) if n and tuple(ws[i:i + n]) in wanted]
            hit.update(p for i in at for p in range(i, i + n))
            if at and item_id is not None:
                ids.add(str(item_id))
        found[doc_id, text] = (len(ws), hit, sorted(ids))
    return found


def planted(seed, n=40):
    """Items of 1 to 30 words; documents that hold some, whole or in part."""
    rng = random.Random(seed)
    vocab = ["a", "B", "cé", "d4", "Éa", "ñ", "e", "ff"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 30]))))
             for i in range(8)]
    items += [(8, None), (9, ""), (9, "-- ++"), (3, items[4][1]), (None, "only here now")]
    docs = []
    for i in range(n):
        parts = ["".join(rng.choice("xyz q") for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").split(" ")
            cut = rng.randint(0, 3)
            parts += [", ".join(item[cut:]).upper() if rng.random() < 0.3 else " ".join(item[cut:]),
                      "zz"]
        docs.append((i, "\n".join(parts)))
    return docs, items


def rows_of(found):
    return {(r["doc_id"], r["text_hash"]): r for r in found.collect()}


def test_against_brute_force(spark):
    docs, items = planted(1)
    docs += [(100, None), (101, ""), (5, "only here now"), (None, docs[0][1]), (0, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    for blocks in (500_000, 3):   # one broadcast, and several passes
        found = find(frame, bench, block_windows=blocks)
        hashed = frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
        texts = {(r["doc_id"], r["h"]): r["text"] for r in hashed.collect()}
        got = rows_of(found)
        assert set(got) == set(texts)
        for k, r in got.items():
            n, hit, ids = expected[k[0], texts[k]]
            spans = {p for s in r["spans"] for p in range(s["start"], s["end"])}
            assert (r["n_words"], r["n_hit"], spans, r["items"]) == (n, len(hit), hit, ids)
            assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert got[0, next(h for d, h in got if d == 0)]["copies"] == 2
        assert sum(r["copies"] for r in got.values()) == len(docs)


def test_removal_of_words_and_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Before, ONE two; {item[8:]}! After.", "x"), (2, "clean text", "y"),
         (3, None, "z"), (4, item, "w")], "doc_id long, text string, `a.b` string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    cut = {r["doc_id"]: r for r in decontaminate(docs, bench).collect()}
    assert cut[1]["text"] == "Before! After." and cut[1]["a.b"] == "x"
    assert (cut[2]["text"], cut[3]["text"], cut[4]["text"]) == ("clean text", None, "")
    kept = decontaminate(docs, bench, whole=True)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark, odd_rows())
    bench = spark.createDataFrame([(1, "one two three"), (2, "word word"), (1, "one two three")],
                                  "item_id long, text string")
    got = find(clashing(docs, "items", "n_hit", "id", "hash", "ws"), bench)
    assert got.agg(F.sum("copies")).first()[0] == len(odd_rows())
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[5]["n_hit"] == 30_000 and by_id[5]["items"] == ["2"]
    assert by_id[3]["copies"] == 2 and by_id[3]["n_hit"] == 3
    assert by_id[1]["n_words"] == 0 and by_id[None]["n_hit"] == 0
    assert find(docs.limit(0), bench).count() == 0
    assert find(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_common_window_of_many_items(spark):
    shared = " ".join(f"w{i}" for i in range(10))
    bench = spark.createDataFrame([(i, f"{shared} t{i}") for i in range(200)],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{shared} u" * 3) for i in range(50)],
                                 "doc_id long, text string")
    for r in find(docs, bench).collect():
        assert len(r["items"]) == 200 and r["items"] == sorted(r["items"])


def test_query_over_the_whole_table(spark):
    got = op13_decontamination(spark, SF_SMALL).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
             .select("item_id", "text").collect()]
    expected = {d: v for (d, _), v in brute(docs, items).items()}
    assert len(got) == len(docs)
    for r in got:
        n, hit, ids = expected[r["doc_id"]]
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert tuple(r)[1:] == (n, len(hit), len(ids), digest, bool(hit))


def test_no_python_in_the_plan(spark):
    plan = op13_decontamination(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
