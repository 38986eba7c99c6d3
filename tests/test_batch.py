"""Batch classifier on weighted rows of equal bins."""

import numpy as np
from pyspark.sql import functions as F

from featurelens.operators import batch
from featurelens.plans.tables import Tables
from featurelens.sources.loader import prepare
from featurelens.spec import COMPARISON, RunSpec


def test_units_keep_every_row_and_are_bounded(spark):
    rng = np.random.default_rng(5)
    one = [(i, float(rng.integers(0, 4)), float(rng.normal())) for i in range(3000)]
    two = [(i, float(rng.integers(1, 5)), None if i % 7 == 0 else float(rng.normal())) for i in range(3000)]
    schema = "id long, few double, many double"
    t = Tables(prepare(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema),
                       RunSpec(rank_buckets=3, mode=COMPARISON, dataset1_name="one", dataset2_name="two")))
    cuts = batch.bin_bounds(t)
    assert {0.0, 1.0, 2.0, 3.0, 4.0} <= set(cuts["few"]) and len(cuts["many"]) == 31
    values = np.array([r[2] for r in one + two if r[2] is not None])
    assert np.allclose(cuts["many"], np.quantile(values, np.arange(1, 32) / 32), rtol=1e-12)
    train, test = batch.binned_rows(t)
    kinds, rows = train.count(), train.agg(F.sum("n")).first()[0]
    assert rows + test.agg(F.sum("n")).first()[0] == 6000 and kinds <= 2 * 5 * 32
    single, grouped = batch.units(train), batch.units(train, 500)
    assert single.count() == rows and single.where("weight <> 1").count() == 0
    assert grouped.count() <= 500 + kinds
    by = [c for c in train.columns if c != "n"]
    back = grouped.groupBy(*by).agg(F.sum("weight").alias("w")).join(train, by)
    assert back.count() == kinds and back.where("abs(w - n) > 1e-9").count() == 0
    _, report = batch.batch_effect(t)
    value = {r["Metric"]: r["Value"] for r in report.collect()}
    assert 0.6 < value["Classifier accuracy"] < 0.75 and value["Top feature 1: few"] > 0.5
