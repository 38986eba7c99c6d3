import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featurelens.llm import fingerprint as fp
from featurelens.llm import queries

SF_SMALL = "/root/testdata/sf0.001"


def plain_entropies(data):
    full = int(fp.WEIGHT[64])
    return [(full - sum(int(fp.WEIGHT[c]) for c in Counter(data[i:i + 64]).values())) * 1000 // full
            for i in range(len(data) - 63)]


def plain_features(data, ranks):
    """The windows elected 16 times or more, by holding every election."""
    if len(data) < 64:
        return [data.ljust(64, bytes([len(data)]))] if data else []
    rank = [int(ranks[e]) for e in plain_entropies(data)]
    votes = Counter()
    for i in range(-63, len(rank)):
        some = range(max(0, i), min(len(rank), i + 64))
        votes[min(some, key=lambda j: (rank[j], j))] += 1
    return list(dict.fromkeys(data[i:i + 64] for i in sorted(votes) if votes[i] >= 16))


def plain_digest(data, ranks):
    found, out = plain_features(data, ranks), b""
    for i in range(0, len(found), 160):
        bits = np.zeros(2048, np.uint8)
        for f in found[i:i + 160]:
            h = int(fp.hash_of(np.frombuffer(f, np.uint8).reshape(1, 64))[0])
            bits[[h >> 11 * k & 2047 for k in range(5)]] = 1
        out += np.packbits(bits).tobytes()
    return out


def plain_alike(one, other):
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a, b = ([set(np.flatnonzero(np.unpackbits(np.frombuffer(f[i:i + 256], np.uint8)))) for i in range(0, len(f), 256)]
            for f in (one, other))

    def side(x, y):
        best = []
        for p in x:
            scores = []
            for q in y:
                chance, most = len(p) * len(q) / 2048, min(len(p), len(q))
                floor = chance + 0.3 * (most - chance)
                scores.append(max(0, (len(p & q) - floor) / (most - floor)))
            best.append(max(scores))
        return sum(s * len(p) for s, p in zip(best, x)) / sum(map(len, x))

    return (side(a, b) + side(b, a)) / 2 if len(a) == len(b) else side(a, b) if len(a) < len(b) else side(b, a)


RANKS = fp.ranks_of(np.random.default_rng(4).integers(0, 90, fp.SCALE + 1))


@given(st.lists(st.binary(max_size=300) | st.text("ab é", max_size=200).map(str.encode), max_size=5))
@settings(max_examples=120, deadline=None)
def test_digests_by_every_election(texts):
    assert fp.digests(texts, RANKS) == [plain_digest(t, RANKS) for t in texts]


def test_entropies():
    data = np.random.default_rng(1).integers(0, 9, 70000).astype(np.uint8)
    got = fp.entropies(data)
    for i in (0, 1, 32767, 32768, 40000, len(got) - 1):
        assert got[i] == plain_entropies(data[i:i + 64].tolist())[0]
    assert fp.entropies(np.zeros(64, np.uint8)).tolist() == [0]
    assert fp.entropies(np.arange(64, dtype=np.uint8)).tolist() == [1000]


def test_ranks():
    counts = np.arange(fp.SCALE + 1)[::-1].copy()
    ranks = fp.ranks_of(counts)
    assert sorted(ranks) == list(range(fp.SCALE + 1)) and ranks[1000] == 0 and ranks[101] == 899 and ranks[0] == 1000


def test_with_next_at_all_ranges(spark, rows):
    data = [(i, f"t{i}") for i in range(40)] + [(7, f"x{i}") for i in range(60)] + [(None, "n"), (None, None), (7, "x1"), (7, "x1")]
    frame = rows.frame(data, "doc_id int, text string").repartition(5)

    def each(held):
        return {"a": [a for a, _ in held], "b": [b for _, b in held]}

    got = [(r["doc_id"], r["a"], r["b"]) for r in fp.with_next(frame, each, "a string, b string").collect()]
    signed = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in data], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(((i is not None, i or 0, signed[t or ""], t or "") for i, t in data))
    texts = [t for *_, t in order]
    expect = [(i if known else None, t, texts[(k + 1) % len(texts)]) for k, (known, i, _, t) in enumerate(order)]
    assert sorted(got, key=str) == sorted(expect, key=str)
    one = fp.with_next(frame.where("doc_id = 3"), each, "a string, b string").collect()
    assert [(r["a"], r["b"]) for r in one] == [("t3", "t3")]
    assert fp.with_next(frame.limit(0), each, "a string, b string").collect() == []


def test_fingerprint_column(rows):
    frame = rows.frame([(1, "some text " * 40, 1), (2, None, 2), (3, "", 3), (4, "some text " * 40, 4)],
                       "doc_id int, text string, fingerprint int")
    got = fp.fingerprints(frame, RANKS)
    assert got.columns == ["doc_id", "fingerprint"]
    made = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert made[1] == made[4] != b"" and made[2] == made[3] == b""
    joined = got.alias("a").join(got.alias("b"), "doc_id").select("doc_id", fp.likeness("a.fingerprint", "b.fingerprint").alias("s"))
    assert {r["s"] for r in joined.collect()} == {1.0}


@pytest.mark.parametrize("a,b", [(b"", b""), (b"", b"q" * 90), (b"abc", b"abd"), (b"abc" * 99, b"abc" * 90 + b"xyz" * 30)])
def test_likeness_bounds(a, b):
    x, y = fp.digests([a, b], RANKS)
    assert fp.alike(x, y) == fp.alike(y, x) == pytest.approx(plain_alike(x, y)) and 0 <= fp.alike(x, y) <= 1


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    counts = Counter()
    for _, t in docs:
        counts.update(fp.entropies(np.frombuffer(t.encode(), np.uint8)).tolist())
    ranks = fp.ranks_of(np.array([counts[i] for i in range(fp.SCALE + 1)]))
    got = {r["doc_id"]: r for r in queries.op11_document_fingerprints(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    near = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) < 3000:  # the plain version holds every election
            own, changed = (plain_digest(t.encode(), ranks) for t in (text, edited))
            assert base64.b64decode(r["fingerprint"]) == own and base64.b64decode(r["edited_fingerprint"]) == changed
            assert r["near_edited"] == pytest.approx(plain_alike(own, changed))
            if len(after) < 3000:
                assert r["near_next"] == pytest.approx(plain_alike(own, plain_digest(after.encode(), ranks)))
        near.append((r["near_edited"], r["near_next"]))
    assert np.median([e for e, _ in near]) > 0.5 and np.median([n for _, n in near]) == 0
