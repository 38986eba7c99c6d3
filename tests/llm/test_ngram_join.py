import random

import pytest

from featurelens.llm import ngram_join


def brute(texts, k=4, percent=85):
    """Components by comparing all pairs."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(fold).encode().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}


def brute_links(texts, k=4, percent=85):
    """Links of each document by comparing all pairs."""
    comps = brute(texts, k, percent)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(fold).encode().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return {i: (*comps[i], sum(a != i and bool(sets[i]) and 100 * len(sets[a] & sets[i]) >= percent * len(sets[a] | sets[i]) for a in sets))
            for i in sets}


def found_links(rows, texts, **how):
    frame = rows.frame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.link_counts(frame, **how).collect()}


def found(rows, texts, **how):
    frame = rows.frame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame, **how).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(rows, seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = {}
    for i in range(160):
        kind = r.random()
        if texts and kind < 0.5:
            w = (texts[r.choice(list(texts))] or "").split()
            for _ in range(r.randrange(0, 3)):
                if w:
                    w[r.randrange(len(w))] = f"w{r.randrange(200)}"
        else:
            w = [f"w{r.randrange(200)}" for _ in range(r.choice([0, 2, 3, 4, 20, 60]))]
            w = w + passage if kind < 0.7 else w
        texts[i] = " ".join(w)
    assert found(rows, texts) == brute(texts)
    assert found_links(rows, texts) == brute_links(texts)


def test_large_group_of_near_copies(rows):
    r, base = random.Random(9), [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(250):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"n{r.randrange(9)}"
        texts[i] = " ".join(w)
    assert found(rows, texts) == brute(texts)
    assert found_links(rows, texts) == brute_links(texts)


def test_edge_rows(rows):
    frame = rows.frame([(5, None, 1), (6, "", 1), (7, "One TWO", 1), (8, "one two", 1), (8, "one two", 1), (9, "two one", 1),
                        (None, "one two", 1), (None, "alone here now then", 1), (10, " \t\n", 1)],
                       "doc_id long, text string, component_id int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted([(5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (8, 1, 7), (9, 1, 9), (None, 1, 7),
                                           (None, 1, None), (10, 0, 10)], key=str)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 5, 6, 7, 9, 10]
    assert ngram_join.near_duplicates(frame.limit(0)).count() == 0


def test_long_text_and_parameters(rows):
    long = " ".join(f"l{i % 5000}" for i in range(60_000))
    texts = {1: long, 2: long + " end", 3: "a b c", 4: "a b d"}
    assert found(rows, texts) == brute(texts)
    assert found(rows, texts, k=1, percent=50) == brute(texts, 1, 50)


def test_one_row_of_each_component_stays_whatever_its_id(rows):
    base = [" ".join(f"{c}{j}" for j in range(60)) for c in "abcdef"]
    data = [(None, base[0]), (None, base[1]), (None, base[1] + " x"), (5, base[2]), (5, base[3]), (9, base[2] + " x"), (7, base[3] + " x"),
            (3, base[4]), (4, base[4]), (4, base[5]), (2, base[5] + " x"), (3, base[4]), (None, ""), (None, " "), (5, None), (5, None)]
    data += [(None, " ".join(f"n{i}w{j}" for j in range(20))) for i in range(40)]
    comps = brute({n: t for n, (_, t) in enumerate(data)})
    want = {}
    for n, (i, _) in enumerate(data):
        want.setdefault(comps[n][1], []).append(i)
    want = {c: min((i for i in ids if i is not None), default=None) for c, ids in want.items()}
    kept = ngram_join.keep_one(rows.frame(data, "doc_id long, text string")).collect()
    of = {(i, t): comps[n][1] for n, (i, t) in enumerate(data) if comps[n][0]}
    got = [(of[r["doc_id"], r["text"]], r["doc_id"]) for r in kept if (r["doc_id"], r["text"]) in of]
    assert sorted(got) == sorted((c, i) for c, i in want.items() if comps[c][0])
    bare = [(r["doc_id"], r["text"]) for r in kept if (r["doc_id"], r["text"]) not in of]
    assert sorted(bare, key=str) == sorted([(None, ""), (None, " "), (5, None), (5, None)], key=str)


def test_members_of_a_group_may_differ_in_links(rows):
    # equal prefixes and sizes (rare words first), bodies that differ beyond them
    common = [f"c{i}" for i in range(400)]
    texts = {i: " ".join(common) for i in range(40)}
    for i in range(40, 60):
        texts[i] = " ".join([f"r{i // 10}x{j}" for j in range(20)] + common[:60 + i % 10])
    assert found(rows, texts) == brute(texts)
    assert found_links(rows, texts) == brute_links(texts)


def test_links_of_edge_rows(rows):
    frame = rows.frame([(5, None), (6, ""), (7, "One TWO"), (8, "one two"), (8, "one two"), (9, "two one"), (None, "one two"),
                        (None, "alone here now then")], "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.link_counts(frame).collect()]
    assert sorted(got, key=str) == sorted([(5, 0, 5, 0), (6, 0, 6, 0), (7, 1, 7, 3), (8, 1, 7, 3), (8, 1, 7, 3), (9, 1, 9, 0),
                                           (None, 1, 7, 3), (None, 1, None, 0)], key=str)
    assert ngram_join.link_counts(frame.limit(0)).count() == 0


def test_query_on_the_given_table(spark):
    from featurelens.llm.queries import op4_ngram_jaccard_join

    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_ngram_jaccard_join(spark, path).collect()}
    assert got == brute(texts)
