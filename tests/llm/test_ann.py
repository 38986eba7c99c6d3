import numpy as np
from pyspark.sql import functions as F

from featurelens.llm import ann


def brute(ids, x, query, k):
    """Ids and cosines of the k nearest rows other than ``query`` (an index)."""
    x = x.astype(np.float64)
    cos = (x * x[query]).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[query]))
    order = [i for i in np.lexsort((ids, -np.round(cos, 12))) if i != query][:k]
    return [(int(ids[i]), float(cos[i])) for i in order]


def test_recall_and_scores_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.nearest(rows, F.col("vec_id") % 50 == 0).collect()
    table = rows.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy())
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        true = brute(ids, x, q, 5)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        known = dict(brute(ids, x, q, len(ids)))
        assert all(abs(known[i] - s) < 1e-12 for _, i, s in mine)
        hits, total = hits + len({m[1] for m in mine} & {t[0] for t in true}), total + 5
    assert hits / total >= 0.9


def test_ties_copies_and_bad_vectors(rows):
    same = [1.0, 2.0, 0.0]
    data = [(i, same, i) for i in range(0, 40)] + [(100, [1.0, 0.0, 0.0], 1), (101, None, 1), (102, [0.0, 0.0, 0.0], 1),
            (103, [float("nan"), 1.0, 1.0], 1), (104, [None, 1.0, 1.0], 1), (105, [float("inf"), 1.0, 1.0], 1),
            (106, [1.0], 1), (None, same, 1), (3, same, 3)]
    frame = rows.frame(data, "vec_id long, embedding array<double>, score int")
    got = rows.dicts(ann.nearest(frame, F.col("vec_id") % 50 == 0), "query_id", "rank")
    zero = [r["vec_id"] for r in got if r["query_id"] == 0]
    assert zero == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [0, 1, 2, 3, 4]
    assert {r["query_id"] for r in got} == {0, 100}


def test_few_rows_and_none(rows):
    frame = rows.frame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = rows.dicts(ann.nearest(frame, F.col("vec_id") == 0), "rank")
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1)]
    assert ann.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(frame, F.lit(False)).count() == 0


def test_blocks_of_a_large_leaf_hold_every_row():
    x = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    forest = ann.Forest(x[:100], 600, trees=3, leaves=4, block=20, seed=1)
    cells = forest.cells(ann.units(x), np.arange(600))
    assert cells.shape == (600, 3) and len(np.unique(cells)) > 3 * 4 * 4
    everywhere = set(forest.visit(ann.units(x[:1])[0], search=10.0))
    assert everywhere == set(range(sum(int(b.sum()) for b in forest.blocks)))


def test_equal_cosines_of_different_vectors_go_to_smaller_ids():
    ids = np.random.default_rng(2).permutation(60).astype(np.int64)
    x = np.array([[1.0, 2.0, 0.5]]) * 2.0 ** (np.arange(60) % 30 - 15)[:, None] + np.array([[0.0, 0.0, 0.0]])
    x[ids == 4] = [3.0, -1.0, 0.0]
    cell = ann.packets((np.arange(60), np.zeros(60, np.int64)), ids, x)
    asked = ann.packets((np.arange(1), np.zeros(1, np.int64)), np.array([99]), np.array([[1.0, 1.0, 1.0]]))
    got = ann.best(ann.pa.Table.from_batches([cell]), ann.pa.Table.from_batches([asked]), np.dtype(np.float64), 3, 6)
    assert got["point"].to_pylist() == [0, 1, 2, 3, 5, 6]
