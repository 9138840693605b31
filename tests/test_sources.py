"""JSON-lines scans (FIXTURES.md §3.1), query sources and sinks."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.sources.jsonl import read_jsonl_strict, read_jsonl_tolerant
from quarry.sources.queries import read_query_lines, reference_queries
from quarry.sources.sinks import id_mapping, write_documents, write_embeddings, write_tables

GOOD = '{"url": "u1", "date": "d", "title": "T", "summary": "S", "text": "X"}'
LINES = [
    GOOD,
    '{"url": "u2", "date": "d", "title": null, "summary": 5, "text": "X"}',
    '{"url": "u3", "date": "d", "summary": "S", "text": "X"}',
    "not json",
    "",
    '{"url": "u4", "date": "d", "title": "T", "summary": "S"',
    "7",
    '{"url": "u5", "url": "u6", "date": "d", "title": "T", "summary": "S", "text": "X"}',
    '{"url": "u7", "date": "d", "title": "T", "summary": NaN, "text": "X"}',
    '{"url": "u8", "date": "d", "summary": "S", "text": "X", "score": -Infinity}',
    '{"url": "u9", "date": "d", "title": "T", "summary": "S", "text": "X", "text": null}',
    "{'url': 'u10', 'date': 'd', 'title': 'T', 'summary': 'S', 'text': 'X'}",
    '{"url": "u11", "date": NaN, "title": {"a": 1, "a": 2}, "summary": "S", "text": "X"}',
]


def write_lines(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_tolerant_scan(spark, tmp_out):
    path = tmp_out + "/raw.jsonl"
    write_lines(path, LINES)
    good, rejects = read_jsonl_tolerant(spark, path)
    g = {r["url"]: r for r in good.collect()}
    assert set(g) == {"u1", "u2", "u6", "u7", "u9"}
    assert (g["u7"]["summary"], g["u7"]["text"], g["u9"]["text"]) == ("", "X", "")
    assert (g["u2"]["title"], g["u2"]["summary"]) == ("", "")
    assert g["u1"]["doc_id"] < g["u2"]["doc_id"]
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == sorted(["missing field title", "malformed", "malformed", "malformed",
                              "not an object", "missing field title", "malformed", "malformed"])


def test_strict_scan_fails_on_bad_line(spark, tmp_out):
    path = tmp_out + "/raw.jsonl"
    write_lines(path, [GOOD, "not json"])
    with pytest.raises((PySparkException, Py4JJavaError),
                       match="MALFORMED_RECORD|Malformed records"):
        read_jsonl_strict(spark, path).collect()
    write_lines(path, [GOOD])
    assert read_jsonl_strict(spark, path).first()["url"] == "u1"


def test_query_lines(spark, tmp_out):
    path = tmp_out + "/q.txt"
    write_lines(path, ["  first query ", "", "   ", "second"])
    rows = read_query_lines(spark, path).orderBy("query_id").collect()
    assert [r["query"] for r in rows] == ["first query", "second"]


def test_reference_queries(spark):
    q = reference_queries(spark).orderBy("query_id").collect()
    assert len(q) == 10 and q[0]["query"] == "экономика"


def test_id_mapping_last_duplicate_wins(spark):
    docs = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "url string, doc_ord long")
    assert {r["url"]: r["idx"] for r in id_mapping(docs).collect()} == {"a": 2, "b": 1}


def test_sinks_round_trip(spark, tmp_out):
    docs = spark.createDataFrame([(1, "t")], "doc_id long, title string")
    write_documents(docs, tmp_out + "/docs")
    write_documents(docs, tmp_out + "/docs_json", fmt="json")
    assert spark.read.parquet(tmp_out + "/docs").count() == 1
    assert spark.read.json(tmp_out + "/docs_json").first()["title"] == "t"
    emb = spark.createDataFrame([(1, [0.6, 0.8])], "doc_id long, embedding array<float>")
    write_embeddings(emb, tmp_out + "/emb")
    assert spark.read.parquet(tmp_out + "/emb").first()["embedding"] == pytest.approx([0.6, 0.8])
    write_tables({"m": docs.select(F.lit(1).alias("x"))}, tmp_out + "/eval")
    assert spark.read.parquet(tmp_out + "/eval/m").first()["x"] == 1


def test_jsonl_corpus_to_search_end_to_end(spark, tmp_out):
    """J5 then J1 on a JSON-lines corpus: tolerant scan, preparation, index,
    text search, id mapping (a URL given twice keeps its last position)."""
    from quarry.operators.analyze import Analyzer
    from quarry.operators.index import build_index
    from quarry.plans.corpus import build_corpus
    from quarry.plans.search import SearchEngine

    docs = [
        {"url": "u/1", "date": "2020-01-01", "title": "Oil prices", "summary": "Oil",
         "text": "Oil prices rose sharply."},
        {"url": "u/2", "date": "2020-01-02", "title": "Gas", "summary": "Gas",
         "text": "Gas demand fell; oil flat."},
        {"url": "u/1", "date": "2020-01-03", "title": "Oil again", "summary": "Oil",
         "text": "Oil, oil and more oil!"},
    ]
    path = tmp_out + "/corpus.jsonl"
    write_lines(path, [json.dumps(d) for d in docs] + ["broken {"])
    good, rejects = read_jsonl_tolerant(spark, path)
    assert rejects.count() == 1
    corpus = build_corpus(good, tmp_out + "/prepared", Analyzer(lists=(("en", ("and",)),)))
    row = corpus.where(F.col("date") == "2020-01-03").first()
    assert row["id"] == "u/1" and row["text_processed"] == "oil , oil more oil !"
    idx = build_index(corpus, tmp_out + "/index", n_parts=2)
    eng = SearchEngine(corpus=corpus, index=idx, doc_vectors=None,
                       analyzer=Analyzer(lists=(("en", ("and",)),)))
    q = spark.createDataFrame([(1, "oil")], "query_id long, query string")
    top = eng.text(q, 3).orderBy("rank").collect()
    assert [r["date"] for r in top] == ["2020-01-03", "2020-01-01", "2020-01-02"]
    assert top[0]["score"] == 1.0
    mapping = id_mapping(idx.docs.join(corpus.select("doc_id", "url"), "doc_id"))
    assert {r["url"]: r["idx"] for r in mapping.collect()} == {"u/1": 2, "u/2": 1}
