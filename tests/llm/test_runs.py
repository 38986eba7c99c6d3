import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featurelens.llm import queries, runs
from featurelens.llm.words import words

SF_SMALL = "/root/testdata/sf0.001"


def plain(seq, least):
    """Runs by trying every period."""
    n, out = len(seq), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            size = j + q - i
            if size >= max(2 * q, least) and not any(all(seq[x] == seq[x + r] for x in range(i, i + size - r))
                                                      for r in range(1, q)):
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda t: (t[0], t[2]))


def plain_collapsed(ws, found):
    return " ".join(w for i, w in enumerate(ws) if not any(s + p <= i < s + n for s, n, p in found))


@given(st.lists(st.integers(1, 3), max_size=40), st.integers(2, 14), st.integers(0, 39), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_runs_of_sequences(seq, least, a, p):
    seq = [seq[a + (i - a) % p] if i >= a and a + p <= len(seq) else x for i, x in enumerate(seq)]
    assert [tuple(r) for r in runs.runs(seq, least).tolist()] == plain(seq, least)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "Ab", "é"]), max_size=60), max_size=4))
@settings(max_examples=200, deadline=None)
def test_stretches_lose_no_run(texts):
    found = runs.runs_of(words(pa.array([" \t".join(t) for t in texts], pa.string())))
    assert found == [plain(t, runs.LEAST) for t in texts]


def test_long_text():
    rng = random.Random(3)
    unit = [str(rng.randrange(5000)) for _ in range(7000)]
    seq = ["x"] + unit * 3 + ["y"]
    assert runs.runs_of(words(pa.array([" ".join(seq)]))) == [[(1, 21000, 7000)]]


def test_table(rows):
    text = "one two " + "a b c " * 6 + "end"
    frame = rows.frame([(1, text, 5), (None, None, 6), (3, "", 7), (1, text, 5), (4, "w " * 30, 8)],
                       "doc_id long, text string, runs int")
    got = rows.dicts(runs.find(frame))
    assert len(got) == 5 and list(got[0]) == ["doc_id", "n_words", "runs", "collapsed"]
    for r in got:
        source = {1: text, None: "", 3: "", 4: "w " * 30}[r["doc_id"]].split()
        expect = plain(source, 12)
        assert [tuple(x) for x in r["runs"]] == expect and r["n_words"] == len(source)
        assert r["collapsed"] == plain_collapsed(source, expect)
    assert rows.dicts(runs.find(frame.limit(0))) == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    many = 0
    for d in docs:
        ws = (d["text"] or "").encode().split()
        ws = [w.decode() for w in ws]
        h = zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        if n > 1500:  # the plain version takes n^2 steps
            continue
        expect, r = plain(ws, 12), got[d["doc_id"]]
        many += len(expect)
        assert r["n_runs"] == len(expect)
        digest = hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in expect).encode()).hexdigest()
        assert r["runs_sha256"] == digest
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(ws, expect).encode()).hexdigest()
        top = min(expect, key=lambda t: (-t[1], t[0], t[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (top or (None, None, None))
        assert r["exponent_milli"] == (top and 1000 * top[1] // top[2])
    assert many > 10


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 300])
def test_range_minimum(size):
    import numpy as np

    rng = np.random.default_rng(size)
    depths = rng.integers(0, 50, size)
    e = runs.Extension(depths.astype(np.int32), np.arange(size))
    i, j = np.meshgrid(np.arange(size), np.arange(size))
    got = e.common(i.ravel(), j.ravel())
    assert got.tolist() == [depths[min(a, b):max(a, b) + 1].min() for a, b in zip(i.ravel(), j.ravel(), strict=True)]
