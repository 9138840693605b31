import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.bpe import decode, encode, op1_bpe
import quarry.llm.records as R
from quarry.llm.records import (LibraryCoder, frame, masked, op4_token_records, read_at, read_index,
                                read_records, records, write_index, write_records)
from quarry.llm.wordbpe import WordBpe
from quarry.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, documents, odd_rows

VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def own():
    with open(VOCAB, "rb") as f:
        return WordBpe(f.read())


def ids_of(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_ids_equal_the_librarys(own, library):
    rng = random.Random(5)
    letters = "abcdefgh THE'stre.,!?0129éßñçΣσ漢字😀\t\ń \x1c"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    cases += ["", "<|endoftext|>a<|startoftext|> <|end", "a" * 5000, "ΑΣ ΑΣ.", "İI", "don't we'll"]
    for t in cases:
        got = library.encode(t, add_special_tokens=False).ids
        assert ids_of(own, t) == got, t
        assert own.decode(got) == library.decode(got, skip_special_tokens=False)


def test_every_token_string_encodes_alike(own, library):
    vocab = library.get_vocab()
    for t in sorted(vocab)[::37]:
        t = t.removesuffix("</w>")
        assert ids_of(own, t) == library.encode(t, add_special_tokens=False).ids


def test_many_chunks_at_once(library, monkeypatch):
    with open(VOCAB, "rb") as f:
        coder = LibraryCoder(f.read())
    rng = random.Random(9)
    letters = "abcdefgh THE'stre.,!?0129éßñçΣσ漢字😀\t\ń \x1c" + chr(0xF8FF) + chr(0xF8C1)
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    cases += ["", "<|endoftext|>a<|startoftext|> <|end", "a" * 5000, "ΑΣ ΑΣ.", "İI", "don't we'll"]
    cases += [t.removesuffix("</w>") for t in sorted(library.get_vocab())[::29]]
    want = [library.encode(t, add_special_tokens=False).ids for t in cases]
    assert [x.tolist() for x in coder.encode(cases)] == want
    monkeypatch.setattr(R, "BLOCK_CHARS", 100)
    for size, longest in ((3, 4), (40, 48)):
        monkeypatch.setattr(R, "MEMO_CHUNKS", size)
        monkeypatch.setattr(R, "MEMO_CHARS", longest)
        assert [x.tolist() for x in coder.encode(cases)] == want
    # Where the pair test proves nothing, the library is asked.
    coder.young, coder.old = {}, {}   # nothing is known
    monkeypatch.setattr(coder.ranks, "fits", lambda a, b: np.zeros(len(a), bool))
    assert [x.tolist() for x in coder.encode(cases)] == want


def test_memo_generations_do_not_change_ids(own, library):
    own.memo.size, own.memo.longest = 3, 4
    for t in ("one two three four five six one two", "fifteen letters"):
        assert ids_of(own, t) == library.encode(t, add_special_tokens=False).ids


def test_encode_decode_odd_rows(spark, library):
    df = clashing(documents(spark, odd_rows()), "ids", "Decoded")
    rows = decode(encode(df, VOCAB), VOCAB).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r["a.b"] == 7
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode(documents(spark, []), VOCAB).count() == 0


def test_op1_whole_table(spark, library):
    import hashlib

    rows = {r.doc_id: r for r in op1_bpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        text = library.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_frame_round_trip_and_damage():
    content = b"".join(frame(i, np.array(x, "<u4")) + b"\n" for i, x in (
        (7, [1, 10, 13]), (None, []), (-3, [70_000, 10])))
    back = [(d, i.tolist()) for _, _, d, i in records(content)]
    assert back == [(7, [1, 10, 13]), (None, []), (-3, [70_000, 10])]
    assert masked(b"123456789") == (((0xCBF43926 >> 15 | 0xCBF43926 << 17) & 0xFFFFFFFF)
                                    + 0xA282EAD8) & 0xFFFFFFFF
    for at in (0, 9, 15, len(content) - 3):
        broken = bytearray(content)
        broken[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            list(records(bytes(broken)))


def test_records_order_index_and_shuffled_reads(spark, library):
    path = scratch_path(spark, "records-test")
    write_records(clashing(documents(spark, odd_rows()), "record"), path, VOCAB, shard_bytes=20_000)
    index = write_index(spark, path).orderBy("start", "shard", "place").collect()
    ids = [r.doc_id for r in index]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in index:
        assert r.start == at
        at += r.n_tokens
    every = {(r.shard, r.place): r for r in read_records(spark, path).collect()}
    some = read_index(spark, path).where("place % 2 = 0").orderBy(F.rand(1))
    got = read_at(spark, path, some).collect()
    assert len(got) == some.count()
    for r in got:
        assert bytes(r.ids) == bytes(every[r.shard, r.place].ids)


def test_empty_table_of_records(spark):
    path = scratch_path(spark, "records-empty")
    write_records(documents(spark, []), path, VOCAB)
    assert write_index(spark, path).count() == 0
    assert read_records(spark, path).count() == 0


def test_op4_whole_table(spark, library):
    rows = {r.doc_id: r for r in op4_token_records(spark, SF_SMALL).collect()}
    start = 0
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [1]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
