"""The two-level rank kernel equals the single-window ranks and numpy quantiles."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from featurelens.plans.rank import cumulate, group_quantiles
from tests.conftest import SF_SMALL


def _vc(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    return (li.select(F.lit("p").alias("feature"), F.col("l_extendedprice").alias("value"))
            .unionByName(li.select(F.lit("q").alias("feature"), F.col("l_quantity").alias("value")))
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


@pytest.mark.parametrize("buckets", [37, 60, None])
def test_ranges_equal_single(spark, buckets):
    vc = _vc(spark)
    one = cumulate(vc, ["feature"], "value", ["n"], buckets=1)
    many = cumulate(vc, ["feature"], "value", ["n"], buckets=buckets)
    a = sorted(tuple(r) for r in one.select("feature", "value", "cum_n", "tot_n").collect())
    b = sorted(tuple(r) for r in many.select("feature", "value", "cum_n", "tot_n").collect())
    assert a == b
    assert buckets is None or many.select("_b").distinct().count() > 8


@pytest.mark.parametrize("buckets", [1, 37])
def test_quantiles_match_numpy(spark, buckets):
    vc = _vc(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    q = group_quantiles(vc, ["feature"], "value", ["n"], probs, buckets)
    got = {(r["feature"], round(r["q"], 6)): r["quantile"] for r in q.collect()}
    t = pq.read_table(f"{SF_SMALL}/lineitem.parquet").to_pandas()
    for f, col in (("p", "l_extendedprice"), ("q", "l_quantity")):
        exp = np.percentile(t[col].to_numpy(), [100 * p for p in probs])
        for p, e in zip(probs, exp):
            assert got[(f, round(p, 6))] == pytest.approx(e, rel=1e-12, abs=1e-9)
