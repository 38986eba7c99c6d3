import random

import pytest

from featurelens.llm import mixing


def pour(sizes, weights, epochs):
    """Targets by handing out the budget again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = sum(sizes.values()), set()
    while True:
        left = budget - sum(epochs * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else left * w[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] >= epochs * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_words_taken(rows, seed):
    r = random.Random(seed)
    names = [None, "", *[f"s{i}" for i in range(r.randrange(1, 8))]]
    data = [(i, " w" * r.choice([0, 1, 5, 40]), r.choices(names, [i + 1 for i in range(len(names))])[0]) for i in range(400)]
    data.append((400, None, "s0"))
    frame = rows.frame(data, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    sizes, taken, target = {}, {}, {}
    source = {d[0]: d[2] for d in data}
    for x in got:
        s = source[x["doc_id"]]
        sizes[s] = sizes.get(s, 0) + x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
        target[s] = x["target"]
        assert x["taken"] % max(1, x["size"]) == 0 and x["taken"] <= 3 * x["size"]
    assert target == pytest.approx(pour(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS))
    assert all(x["source_size"] == sizes[source[x["doc_id"]]] for x in got)
    assert all(0 <= target[s] - taken[s] <= 40 + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))


def test_edge_rows(rows):
    frame = rows.frame([(1, "a b", "x", 5), (1, "a b", "x", 5), (None, "c", None, 5), (2, None, "y", 5), (3, "", "y", 5)],
                       "doc_id long, text string, source string, repeats int")
    got = mixing.mix(frame).collect()
    assert len(got) == 5 and sum(x["taken"] for x in got if x["size"] == 0) == 0
    again = mixing.mixed(frame)
    assert again.columns == frame.columns
    assert {r["doc_id"] for r in again.collect()} <= {1, 2, 3, None}
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0


def test_one_source_keeps_its_size(rows):
    frame = rows.frame([(i, "w " * (i + 1), "only") for i in range(50)], "doc_id long, text string, source string")
    assert all(x["taken"] == x["size"] for x in mixing.mix(frame).collect())


def test_rows_that_share_an_id_are_taken_row_by_row(rows):
    r = random.Random(8)
    data = [(None if i % 3 == 0 else i % 50, " ".join(f"w{i}" for _ in range(r.choice([1, 4, 40]))), s, i % 2)
            for s, n in (("a", 300), ("b", 90), ("c", 30)) for i in range(n)]
    data += [(None, "same words here", "b", 0)] * 40
    frame = rows.frame(data, "doc_id long, text string, source string, extra int")
    decided, again = mixing.mix(frame, carry="text").collect(), mixing.mixed(frame).collect()
    target = pour({s: sum(len(d[1].split()) for d in data if d[2] == s) for s in "abc"}, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    for s in "abc":
        words = sum(len(x["text"].split()) for x in again if x["source"] == s)
        assert 0 <= target[s] - words <= 40 + 1e-6
        assert words == sum(x["taken"] for x in decided if x["target"] == decided_target(decided, data, s))
    assert {tuple(x) for x in again} <= {tuple(d) for d in data}
    assert sorted(map(str, again)) == sorted(map(str, mixing.mixed(frame.repartition(7)).collect()))


def decided_target(decided, data, source):
    """The target that ``mix`` names for a source's texts."""
    texts = {d[1] for d in data if d[2] == source}
    found = {x["target"] for x in decided if x["text"] in texts and not any(
        x["text"] == d[1] and d[2] != source for d in data)}
    return found.pop() if found else None
