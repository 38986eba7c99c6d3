"""Quality score (Q1-Q8) and the conclusions table (K1-K6).

The score is per-feature column algebra over five small per-feature tables
(missingness and IQR outliers of the scored dataset, plausibility, similarity,
constancy flags) joined on ``feature``: no data row is touched here beyond
what those reports already aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables
from . import compare, distribution, outliers, paired, profile, redundancy


def _fmt1(x):
    """``f"{x:.1f}"`` for 0 <= x <= 100: the exact binary value rounded to tenths, half to even.

    x * 2^52 is a whole number for x >= 1 and x * 2^59 for 1 > x >= 2^-6; below that all round to 0.0."""

    def tenths(bits: int):
        ten = (x.cast("double") * float(2 ** bits)).cast("bigint") * 10
        whole, left, half = F.shiftright(ten, bits), ten.bitwiseAND(F.lit(2 ** bits - 1)), F.lit(2 ** (bits - 1))
        return whole + ((left > half) | ((left == half) & (whole % 2 == 1))).cast("bigint")

    rounded = F.when(x >= 1, tenths(52)).otherwise(tenths(59))
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def _missingness(t: Tables) -> DataFrame:
    return t.report("missingness", lambda: profile.missingness(t.p))


def _plausibility(t: Tables) -> DataFrame:
    return t.report("plausibility", lambda: distribution.plausibility(t))


def _similarity(t: Tables) -> DataFrame:
    return t.report("similarity_stats", lambda: compare.similarity_stats(t))


def finished_quality(t: Tables) -> DataFrame:
    return t.report("feature_quality", lambda: quality_score(t))


def quality_inputs(t: Tables) -> DataFrame:
    """(feature, miss_pct, iqr_pct, implaus_pct, sim_score, is_constant, is_near_constant), from finished reports."""
    spec = t.spec
    d2 = spec.dataset2_name
    spark = t.p.d1.sparkSession
    feats = spark.createDataFrame([(f,) for f in t.p.features], "feature string")
    miss = (_missingness(t).where(F.col("Dataset") == d2)
            .select(F.col("Feature").alias("feature"), F.col("Missing_Percent").alias("miss_pct")))
    iqr = (t.report("univariate_outliers", lambda: outliers.univariate_outliers(t))
           .where((F.col("Dataset") == d2) & (F.col("Method") == "IQR"))
           .select(F.col("Feature_or_Method").alias("feature"), F.col("Pct_Outliers").alias("iqr_pct")))
    pl = _plausibility(t).select(F.col("Feature").alias("feature"), F.col("Pct_Outside_Range").alias("implaus_pct"))
    sim = _similarity(t).select(F.col("Feature").alias("feature"), F.col("Similarity_Score").alias("sim_score"))
    fl = t.report("feature_flags", lambda: redundancy.feature_flags(t)).where(F.col("ds") == 2).drop("ds")
    return reduce(lambda a, b: a.join(F.broadcast(b), "feature", "left"), [miss, iqr, pl, sim, fl], feats)


def quality_score(t: Tables) -> DataFrame:
    """Q8: Feature, Quality_Score, Category, Primary_Issues (sorted by score)."""
    th = t.spec.thresholds
    q = quality_inputs(t)
    m, o, p, s = F.col("miss_pct"), F.col("iqr_pct"), F.col("implaus_pct"), F.col("sim_score")
    warn, fair = th.missingness_pct_warn, th.similarity_score_fair
    pen_m = F.when(m > warn, F.least(F.lit(30), F.floor((m - warn) * 1.5))).otherwise(0)
    pen_o = F.when(o > th.outlier_pct_warn, F.least(F.lit(20), F.floor((o - th.outlier_pct_warn) * 2))).otherwise(0)
    pen_p = F.when(p > th.implausible_pct_warn, F.least(F.lit(20), F.floor(p * 2))).otherwise(0)
    pen_s = F.when(s < fair, F.least(F.lit(30), F.floor((fair - s) * 0.5))).otherwise(0)
    pen_r = F.when(F.col("is_constant"), 50).when(F.col("is_near_constant"), 30).otherwise(0)
    score = (F.lit(100) - pen_m - pen_o - pen_p - pen_s - pen_r).cast("int")
    issues = F.concat_ws(
        " | ",
        F.when(m > warn, F.concat(F.lit("Missingness ("), _fmt1(m), F.lit("%)"))),
        F.when(o > th.outlier_pct_warn, F.concat(F.lit("Outliers ("), _fmt1(o), F.lit("%)"))),
        F.when(p > th.implausible_pct_warn, F.concat(F.lit("Implausible Values ("), _fmt1(p), F.lit("%)"))),
        F.when(s < fair, F.concat(F.lit("Low Similarity ("), _fmt1(s), F.lit("/100)"))),
        F.when(F.col("is_constant"), F.lit("Constant")).when(F.col("is_near_constant"), F.lit("Near-Constant")))
    cat = (F.when(F.col("_s") >= th.similarity_score_excellent, "Excellent")
           .when(F.col("_s") >= th.similarity_score_good, "Good")
           .when(F.col("_s") >= th.similarity_score_fair, "Fair")
           .when(F.col("_s") >= th.similarity_score_poor, "Poor")
           .otherwise("Very Poor"))
    r = q.select("feature", score.alias("_s"), issues.alias("_i"))
    return r.select(F.col("feature").alias("Feature"), F.greatest(F.col("_s"), F.lit(0)).alias("Quality_Score"),
                    cat.alias("Category"),
                    F.when(F.col("_i") == "", F.lit("None")).otherwise(F.col("_i")).alias("Primary_Issues")
                    ).orderBy(F.desc("Quality_Score"), "Feature")


def _ranked(df: DataFrame, section: str, order, item: str, value: str, limit: int | None) -> DataFrame:
    w = Window.orderBy(*order)
    r = df.select(F.row_number().over(w).alias("Rank"), F.col(item).alias("Item"),
                  F.col(value).cast("double").alias("Value"))
    if limit is not None:
        r = r.where(F.col("Rank") <= limit)
    return r.select(F.lit(section).alias("Section"), "Rank", "Item", "Value")


def _count_row(df: DataFrame, section: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("Value")).select(
        F.lit(section).alias("Section"), F.lit(0).alias("Rank"), F.lit("count").alias("Item"), "Value")


def conclusions(t: Tables) -> DataFrame:
    """K6: (Section, Rank, Item, Value) — the findings of the automated conclusions.

    Rank 0 rows carry counts; ranked rows list the top items.  The ranked
    lists are global top-k over per-feature tables (p rows each).
    """
    th = t.spec.thresholds
    d2 = t.spec.dataset2_name
    parts = []
    miss = _missingness(t).where((F.col("Dataset") == d2)
                                 & (F.col("Missing_Percent") > th.missingness_pct_critical))
    parts += [_count_row(miss, "high_missing"),
              _ranked(miss, "high_missing", [F.desc("Missing_Percent"), "Feature"], "Feature", "Missing_Percent", 5)]
    pl = _plausibility(t).where(F.col("Pct_Outside_Range") > th.plausibility_pct_high)
    parts += [_count_row(pl, "high_implausible"),
              _ranked(pl, "high_implausible", [F.desc("Pct_Outside_Range"), "Feature"], "Feature",
                      "Pct_Outside_Range", 5)]
    sim = _similarity(t).where(F.col("Similarity_Score") < th.similarity_score_poor)
    parts.append(_count_row(sim, "severe_shift"))
    qs = finished_quality(t)
    parts.append(qs.groupBy("Category").agg(F.count(F.lit(1)).cast("double").alias("Value")).select(
        F.lit("quality_category").alias("Section"), F.lit(0).alias("Rank"), F.col("Category").alias("Item"), "Value"))
    if t.spec.is_paired:
        ps = t.report("paired_stats", lambda: paired.paired_stats(t))
        parts.append(paired.paired_summary(t, ps).select(F.lit("paired_summary").alias("Section"), F.lit(0).alias("Rank"),
                                                     F.col("Metric").alias("Item"), "Value"))
        weak = ps.where(F.col("Agreement").isin("Fair", "Poor"))
        parts.append(_ranked(weak, "weak_agreement", [F.desc_nulls_last("ICC"), "Feature"], "Feature", "ICC", 10))
    return reduce(DataFrame.unionByName, parts)
