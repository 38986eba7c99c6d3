import hashlib

import pytest
from pyspark.sql import functions as F

from featurelens.llm import exact_dedup


def expected(data):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in data:
        groups.setdefault((t or "").translate(fold), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


LONG = "Sentence one is here. And É two!\n" * 4000
DATA = [(1, "Abc"), (2, "aBC"), (3, "Äbc"), (4, "äbc"), (5, None), (6, ""), (7, LONG), (8, LONG.upper().replace("É", "É")),
        (9, LONG + "x"), (9, "abc"), (None, "abc"), (None, "only nulls"), (10, "x" * 30_000), (11, "x" * 30_001)]


def test_against_grouping_by_text(rows):
    frame = rows.frame([(*d, 1) for d in DATA], "doc_id long, text string, recipe int")
    got = [tuple(r) for r in exact_dedup.dedup(frame).collect()]
    assert sorted(got, key=str) == expected(DATA)
    kept = exact_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    stays = {(e[0], e[4]) for e in expected(DATA) if e[3]}  # one row of each text
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = [(r["doc_id"], hashlib.sha256((r["text"] or "").translate(fold).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(rest, key=str) == sorted(stays, key=str)
    assert exact_dedup.dedup(frame.limit(0)).count() == 0


def test_chunks_rejoin_and_follow_the_content(rows):
    frame = rows.frame([(LONG,), ("inserted words. " + LONG,)], "text string")
    a, b = (r["c"] for r in frame.select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == LONG and all(len(c) <= exact_dedup.MAX_CHUNK for c in a)
    assert len(set(a) & set(b)) >= 1


def test_void_identifiers_fall_back_to_texts(rows, monkeypatch):
    """With a hash that collides, groups are the same."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c, *more: real(F.length(c), *more) if not more else real(c, *more))
    frame = rows.frame(DATA, "doc_id long, text string")
    got = [tuple(r) for r in exact_dedup.dedup(frame).collect()]
    assert sorted(got, key=str) == expected(DATA)


@pytest.mark.parametrize("text", ["", ".", "a" * 10_000, ".\n" * 2000])
def test_any_text_is_cut_whole(rows, text):
    got = rows.frame([(text,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first()["c"]
    assert "".join(got) == text


def test_one_row_of_each_text_stays_whatever_its_id(rows):
    data = DATA + [(None, "A"), (None, "B"), (None, "b"), (5, "A"), (5, "B"), (9, "A"), (9, "a"), (12, "B"), (12, "c"), (None, "C")]
    data += [(None, f"clean {i}") for i in range(60)]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for i, t in data:
        t = (t or "").translate(fold)
        last[t] = max((j for j in (i, last.get(t)) if j is not None), default=None)
    kept = exact_dedup.keep_one(rows.frame(data, "doc_id long, text string"))
    got = [((r["text"] or "").translate(fold), r["doc_id"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(last.items(), key=str)
