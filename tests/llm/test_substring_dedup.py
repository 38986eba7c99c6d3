import hashlib
import random

import pytest

from featurelens.llm import substring_dedup
from featurelens.llm.queries import QUERIES


def brute(data, k):
    first = {}
    for i, t in data:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            key = tuple(w[j:j + k])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in data:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j:j + k])] < i:
                gone[j:j + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def found(rows, data, k):
    frame = rows.frame([(i, t, "x") for i, t in data], "doc_id long, text string, kept string")
    return sorted(((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"])
                   for r in substring_dedup.dedup(frame, k=k).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(rows, seed):
    r = random.Random(seed)
    passages = [[f"p{r.randrange(40)}" for _ in range(r.randrange(4, 15))] for _ in range(6)]
    data = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(passages) if r.random() < 0.5 else [f"w{r.randrange(9)}" for _ in range(r.randrange(8))]
        data.append((r.choice([i, i, i, 7, None]) if r.random() < 0.2 else i, r.choice([" ", "\n", "\t "]).join(w)))
    assert found(rows, data, 5) == brute(data, 5)


def test_edge_rows(rows):
    data = [(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (4, "x a b c y"), (None, "a b c"), (-5, "a b c"), (6, "A b c d")]
    assert found(rows, data, 3) == brute(data, 3)
    frame = rows.frame([(1, "x")], "doc_id long, text string").limit(0)
    assert substring_dedup.dedup(frame).count() == 0


def test_long_text_repeated_in_itself_stays(rows):
    long = " ".join(f"l{i % 700}" for i in range(70_000))
    data = [(1, long), (2, "own words " + " ".join(f"l{i}" for i in range(100, 160)) + " end")]
    assert found(rows, data, 50) == brute(data, 50)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in
                 QUERIES["op8_substring_dedup"](spark, sf).collect())
    assert got == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(data, 50))


def test_rows_of_one_id_are_dealt_to_many_groups(rows):
    r = random.Random(4)
    passages = [[f"p{r.randrange(40)}" for _ in range(9)] for _ in range(5)]
    data = [(r.choice([None, 7, 7, i]), " ".join([f"own{i}", *r.choice(passages), f"w{i}", *r.choice(passages)])) for i in range(90)]
    grouped = substring_dedup.sh.grouped(rows.frame(data, "doc_id long, text string"), "doc_id", "text")
    groups = {(g["id"], g["grp"]) for g in grouped.collect()}
    assert all(sum(i == hot for i, _ in groups) > 3 for hot in (None, 7))
    assert found(rows, data, 5) == brute(data, 5)
