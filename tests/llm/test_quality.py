import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from featurelens.llm import quality
from featurelens.llm.queries import KEEP, QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = QUERIES["op6_quality_classifier"](spark, SF)
    got = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(got) > 50 and np.mean(right) > 0.9
    good = [r["score"] for r in got if r["quality"] == 1]
    bad = [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert scored.count() == 1000


def test_indicators_count_once_and_stay_within_a_text():
    text, gram = quality.ngrams(pa.array(["a b a b", None, "", "a b", "c"]))
    assert sorted(set(text.tolist())) == [0, 3, 4]
    assert len(set(zip(text.tolist(), gram.tolist(), strict=True))) == len(text)
    alone = quality.ngrams(pa.array(["a b"]))[1]
    assert set(alone.tolist()) == set(gram[text == 3].tolist())


def test_descent_separates():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50, 8) + (60 if i % 2 else 0)) for i in range(80)]
    label = np.array([i % 2 for i in range(80)])
    model = quality.fit_sets(sets, label, {0: 40, 1: 40})
    margin = np.array([model.weights[s].sum() / np.sqrt(len(s)) + model.bias for s in sets])
    assert ((model.slope * margin + model.level > 0) == (label == 1)).all()


def test_edge_rows(rows):
    docs = rows.frame([(1, "good text here", 9.0), (2, None, 9.0), (3, "", 9.0), (None, "x", 9.0), (1, "good text here", 9.0)],
                      "doc_id long, text string, score double")
    one = rows.frame([(1, 1), (2, 1), (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, one)).collect()
    assert len(got) == 5 and all(abs(r["score"] - 3 / 4) < 1e-12 for r in got)
    none = quality.fit(docs, one.limit(0))
    assert [r["score"] for r in quality.score(docs, none).collect()] == [0.5] * 5
    both = rows.frame([(1, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, quality.fit(docs, both)).collect())
    assert quality.score(docs.limit(0), none).count() == 0


def test_labels_of_the_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = quality.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.fit(docs, labels.where(~fold))
    b = quality.fit(docs, flipped.where(~fold))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.level) == (b.slope, b.level)
    assert KEEP == 0.7


def test_model_does_not_depend_on_how_rows_are_dealt(rows):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    data = [(i // 3, " ".join(rng.choice(vocabulary[(i // 3 % 2) * 20:][:40], 12))) for i in range(240)]
    docs, labels = rows.frame(data, "doc_id long, text string"), rows.frame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    models = [quality.fit(docs.repartition(n), labels) for n in (1, 3, 5, 7)]
    assert all(np.array_equal(m.weights, models[0].weights) and (m.slope, m.level) == (models[0].slope, models[0].level)
               for m in models)


def test_fit_by_its_conditions():
    """Log-count ratios, the dual's optimality conditions and the blend, by plain computation."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, 9) + (10 if i % 2 else 0)) for i in range(60)]
    label = np.array([i % 2 for i in range(60)])
    model = quality.fit_sets(sets, label, {0: 30, 1: 30})
    learn = [i for i in range(60) if i % 5 != 4]
    size = len(model.weights)
    count = {c: np.full(size, float(quality.SMOOTH)) for c in (0, 1)}
    for i in learn:
        for g in sets[i]:
            count[label[i]][g] += 1
    ratio = np.log((count[1] / count[1].sum()) / (count[0] / count[0].sum()))
    rows = [(sets[i], np.array([ratio[g] / len(sets[i]) ** 0.5 for g in sets[i]])) for i in learn]
    y = np.array([1.0 if label[i] else -1.0 for i in learn])
    w = quality.descend(rows, y, size, np.full(len(rows), quality.COST))
    # hinge loss plus half the squared norm: near the least value that subgradient steps reach from there
    def value(v):
        return 0.5 * v @ v + quality.COST * sum(max(0, 1 - t * (v[s] @ x + v[-1])) for t, (s, x) in zip(y, rows, strict=True))
    best, v = value(w), w.copy()
    for k in range(1, 2000):
        g = v.copy()
        for t, (s, x) in zip(y, rows, strict=True):
            if t * (v[s] @ x + v[-1]) < 1:
                g[s] -= quality.COST * t * x
                g[-1] -= quality.COST * t
        v = v - g / (k + 10)
        best = min(best, value(v))
    assert value(w) <= best * 1.01 + 1e-9
    blend = (1 - quality.BLEND) * np.abs(w[:-1]).mean() + quality.BLEND * w[:-1]
    assert np.allclose(model.weights, blend * ratio)
