"""Top and bottom lists against sorting everything."""

import random

import pytest

from featurelens.operators import distribution
from featurelens.plans.tables import Tables
from featurelens.sources.loader import prepare
from featurelens.spec import RunSpec


def _want(rows, feature, n, top):
    held = [(r[feature], r["id"]) for r in rows if r[feature] is not None]
    held.sort(key=lambda p: (-p[0] if top else p[0], p[1] is None, p[1] or ""))
    return [v for v, _ in held[:n]], [i for _, i in held[:n]]


@pytest.mark.parametrize("copies", [1, 6])
def test_against_sorting(spark, copies):
    r = random.Random(copies)
    data = [(None if r.random() < 0.1 else f"k{r.randrange(400)}é", r.choice([None, 1.0, 2.0, -3.5, 0.0, -0.0, float(r.randrange(50))]),
             float(r.randrange(9)) if copies > 1 else None) for _ in range(500)]
    data = list(dict.fromkeys(data))
    d1 = spark.createDataFrame(data, "id string, a double, b double").repartition(copies)
    d2 = spark.createDataFrame(data[:7], "id string, a double, b double")
    t = Tables(prepare(d1, d2, RunSpec(id_col="id", extremes_n=9)))
    got = {(x["Dataset"], x["Feature"], x["Extreme_Type"]): (x["Values"], x["ECG_IDs"]) for x in distribution.extremes(t).collect()}
    names = ("id", "a", "b")
    want = {}
    for name, part in (("D1", data), ("D2", data[:7])):
        rows = [dict(zip(names, row, strict=True)) for row in part]
        for feature in "ab":
            for label, top in (("Top 9", True), ("Bottom 9", False)):
                values, ids = _want(rows, feature, 9, top)
                if values:
                    want[name, feature, label] = (values, ids)
    assert got == want
    t.release()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, a double")
    t = Tables(prepare(none, none, RunSpec(id_col="id")))
    assert distribution.extremes(t).collect() == []
