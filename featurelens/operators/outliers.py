"""Outliers: univariate rules (O1-O3), the summary table (O7) and the
multivariate detectors' record share (O4-O6, see ``multivariate``).

Univariate rules need per-feature constants (quartiles, mean/SD, median/MAD);
they are a features-sized table broadcast back to the value counts, then one
weighted count per rule.  Percentages are of *all* rows of the
dataset (nulls included), as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Tables, ds_name


def dataset_rows(t: Tables) -> DataFrame:
    """(ds, rows) of the analysed tables."""
    a = t.p.d1.agg(F.count(F.lit(1)).alias("rows")).withColumn("ds", F.lit(1))
    b = t.p.d2.agg(F.count(F.lit(1)).alias("rows")).withColumn("ds", F.lit(2))
    return a.unionByName(b)


def feature_grid(t: Tables) -> DataFrame:
    """(ds, feature) for every numeric feature and both datasets (2p rows)."""
    spark = t.p.d1.sparkSession
    return spark.createDataFrame([(d, f) for d in (1, 2) for f in t.p.features], "ds int, feature string")


def univariate_counts(t: Tables) -> DataFrame:
    """(ds, feature, n_iqr, n_z, n_mad) outlier counts per rule."""
    th = t.spec.thresholds
    st = (t.moments.select("ds", "feature", "mean", "sd_pop")
          .join(t.percentiles.select("ds", "feature", "p25", "p75", "p50"), ["ds", "feature"])
          .join(t.mad, ["ds", "feature"], "left"))
    iqr = F.col("p75") - F.col("p25")
    v = F.col("value")
    is_iqr = (v < F.col("p25") - th.outlier_iqr * iqr) | (v > F.col("p75") + th.outlier_iqr * iqr)
    is_z = (F.col("sd_pop") > 0) & (F.abs((v - F.col("mean")) / F.col("sd_pop")) > th.outlier_z)
    is_mad = (F.col("mad") > 0) & (F.abs(0.6745 * (v - F.col("p50")) / F.col("mad")) > th.outlier_mad)
    # a value's rows are judged together, by the value counts that the quantiles come from
    return (t.counts.join(F.broadcast(st), ["ds", "feature"])
            .groupBy("ds", "feature")
            .agg(*[F.sum(F.when(rule, F.col("n")).otherwise(0)).alias(k)
                   for k, rule in (("n_iqr", is_iqr), ("n_z", is_z), ("n_mad", is_mad))]))


def univariate_outliers(t: Tables) -> DataFrame:
    """O1-O3 rows of the outlier summary: Dataset, Analysis_Type, Feature_or_Method, Method, Pct_Outliers.

    A dataset with fewer than ``min_multivariate_rows`` rows is skipped, as
    in the reference (its guard covers the whole outlier stage).
    """
    k = t.spec.thresholds.min_multivariate_rows
    rows = dataset_rows(t).where(F.col("rows") >= k)
    c = feature_grid(t).join(rows, "ds").join(univariate_counts(t), ["ds", "feature"], "left")
    rule = F.explode(F.array(*[F.struct(F.lit(method).alias("Method"), F.col(col).alias("k"))
                               for col, method in (("n_iqr", "IQR"), ("n_z", "Z-Score"), ("n_mad", "MAD"))])).alias("r")
    return c.select("ds", "feature", "rows", rule).select(
        ds_name(t.spec).alias("Dataset"), F.lit("Univariate").alias("Analysis_Type"), F.col("feature").alias("Feature_or_Method"),
        "r.Method", F.bround(F.coalesce("r.k", F.lit(0)) / F.col("rows") * 100, 2).alias("Pct_Outliers"))


def outlier_summary(t: Tables, multivariate: DataFrame | None = None) -> DataFrame:
    """Univariate rows plus, when given, the multivariate record-share rows."""
    u = univariate_outliers(t)
    return u if multivariate is None else multivariate.unionByName(u)
