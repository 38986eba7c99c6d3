import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featurelens.llm import bpe
from featurelens.llm.queries import QUERIES, vocabulary

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = vocabulary()
with open(PATH, "rb") as f:
    DATA = f.read()
RANKS = bpe.read_ranks(DATA)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = bpe.Encoder(DATA, PATTERN), bpe.Decoder(DATA)
TOKENS = sorted(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("abeinst ÉüßÄ \n'09"), st.lists(st.sampled_from(TOKENS), max_size=9).map(
    lambda x: b"".join(x).decode(errors="ignore"))))
def test_encodes_like_the_library_and_back(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(ids, step=3) == text


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    e = bpe.Encoder(DATA, PATTERN)
    text = " ".join(f"word{i * 7919}ation" for i in range(300))
    assert e.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(e.words) <= 20 and len(e.words.transducer.configs) < 150


def test_long_text_and_one_long_word():
    for text in ("Ünder the sea. " * 90_000, "a" * 3000, "xyz" * 2000):
        assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_stream_equals_whole(data, cuts):
    stream, at, got = bpe.Utf8Stream(), 0, ""
    for cut in [*sorted(cuts), len(data)]:
        got, at = got + stream.feed(data[at:cut]), max(at, cut)
    text = got + stream.finish()
    try:
        assert text == data.decode()
    except UnicodeDecodeError:
        assert "�" in text


def test_edge_rows(rows):
    docs = rows.frame([(1, None, "x"), (2, "", "y"), (2, "same same", "z"), (2, "same same", "z"), (None, "é" * 5, None)],
                      "doc_id long, text string, ids string")
    got = rows.dicts(bpe.decode(bpe.encode(docs, PATH, PATTERN).withColumnRenamed("ids", "t"), PATH, "t"), "doc_id")
    assert sorted(r["decoded"] for r in got) == ["", "", "same same", "same same", "é" * 5]
    assert not bpe.encode(docs.limit(0), PATH, PATTERN).count()
    twice = bpe.encode(docs.withColumnRenamed("ids", "decoded"), PATH, PATTERN, decoded="decoded")
    assert twice.columns == ["doc_id", "ids", "decoded"] and twice.count() == 5
    null = rows.frame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(null, PATH).first()["decoded"] == ""


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        ids = LIBRARY.encode_ordinary(r["text"])
        row = got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), bpe.digest(ids))
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
