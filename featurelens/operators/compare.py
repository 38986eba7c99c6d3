"""Two-sample comparison and similarity.

All statistics are aggregates over the shared tables:
moments (T1, T2), the rank table (T3 KS, T5 Mann-Whitney and its tie term),
the pooled-range histogram (T8 overlap, T9 Jensen-Shannon), exact quantiles
(T1 median difference, T12 quantile correlation).  Each is one small
per-feature table; the reports are joins of those on ``feature``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import corr_from_parts, corr_parts
from ..functions.special import kolmogorov_sf_udf, ks_two_sample_sf_udf, norm_sf_udf
from ..plans.rank import local
from ..plans.tables import QGRID, Tables


def _by_ds(df: DataFrame, cols: list) -> DataFrame:
    """(ds, feature, cols...) -> (feature, <col>1, <col>2)."""
    aggs = []
    for c in cols:
        for d in (1, 2):
            aggs.append(F.max(F.when(F.col("ds") == d, F.col(c))).alias(f"{c}{d}"))
    return df.groupBy("feature").agg(*aggs)


def feature_stats(t: Tables, with_grid: bool = False) -> DataFrame:
    """One row per feature with both datasets side by side, from the shared moments and quantiles.

    (feature, n1, n2, mean1, mean2, var_samp1, var_samp2, lo, hi, median1,
    median2[, grid1, grid2]) where grid = the 100 quantiles 0.01..0.99.
    """
    m = _by_ds(t.moments.join(F.broadcast(t.percentiles.select("ds", "feature", F.col("p50").alias("median"))), ["ds", "feature"]),
               ["n", "mean", "var_samp", "min", "max", "median"])
    a = m.select("feature", *[F.coalesce(f"n{d}", F.lit(0)).alias(f"n{d}") for d in (1, 2)], "mean1", "mean2", "var_samp1",
                 "var_samp2", F.least("min1", "min2").alias("lo"), F.greatest("max1", "max2").alias("hi"), "median1", "median2")
    if not with_grid:
        return a
    at = F.struct("q", "quantile")
    grid = [F.transform(F.array_sort(F.collect_list(F.when(F.col("ds") == d, at))), lambda s: s["quantile"]).alias(f"grid{d}")
            for d in (1, 2)]
    return a.join(F.broadcast(t.quantiles(QGRID).groupBy("feature").agg(*grid)), "feature", "left")


def sample_stats(t: Tables, with_grid: bool = False) -> DataFrame:
    """``feature_stats`` with the n >= k guard of the comparison reports."""
    k = t.spec.thresholds.min_compare_n
    return feature_stats(t, with_grid).where((F.col("n1") >= k) & (F.col("n2") >= k))


def _cohen(s: DataFrame) -> DataFrame:
    pooled = ((F.col("n1") - 1) * F.col("var_samp1") + (F.col("n2") - 1) * F.col("var_samp2")) / (
        F.col("n1") + F.col("n2") - 2)
    d = F.when(pooled > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled)).otherwise(F.lit(0.0))
    return s.withColumn("cohen_d", d)


def hist_metrics(t: Tables) -> DataFrame:
    """T8 overlap coefficient and T9 Jensen-Shannon divergence per feature.

    Bins as numpy: densities c / width / n, areas density * (hi-lo)/bins;
    JSD adds 1e-10 to each density, renormalises, natural log.  The
    per-feature bin list is bounded by the bin count, so the final step is
    array algebra on one row per feature.
    """
    eps, n1, n2 = 1e-10, F.col("N1"), F.col("N2")
    d1, d2 = F.col("c1") / F.col("width") / n1, F.col("c2") / F.col("width") / n2
    cell = F.struct("bin", (d1 * F.col("step")).alias("a1"), (d2 * F.col("step")).alias("a2"), (d1 + eps).alias("e1"),
                    (d2 + eps).alias("e2"))
    cells = t.hist.groupBy("feature").agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    s1 = F.aggregate(F.col("_c"), F.lit(0.0), lambda acc, x: acc + x["e1"])
    s2 = F.aggregate(F.col("_c"), F.lit(0.0), lambda acc, x: acc + x["e2"])
    tot = cells.select("feature", "_c", s1.alias("s1"), s2.alias("s2"))

    def jterm(acc, x):
        p = x["e1"] / F.col("s1")
        q = x["e2"] / F.col("s2")
        m = 0.5 * (p + q)
        return acc + 0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)

    ov = F.aggregate(F.col("_c"), F.lit(0.0), lambda acc, x: acc + F.least(x["a1"], x["a2"]))
    js = F.aggregate(F.col("_c"), F.lit(0.0), jterm)
    return tot.select("feature", ov.alias("overlap"), js.alias("jsd"))


def quantile_correlation(t: Tables, stats: DataFrame | None = None) -> DataFrame:
    """Pearson r between the 100 quantiles (0.01..0.99) of each side.

    A constant side gives NULL (the reference adds unseeded noise there).
    """
    st = stats if stats is not None else feature_stats(t, with_grid=True)
    z = st.select("feature", F.explode(F.arrays_zip(F.col("grid1").alias("x"), F.col("grid2").alias("y"))).alias("z"))
    r = z.groupBy("feature").agg(*corr_parts(F.col("z.x"), F.col("z.y"), "qc"))
    return r.select("feature", corr_from_parts("qc").alias("qcorr"))


def _core(t: Tables, with_grid: bool = False) -> DataFrame:
    # one row per feature each
    s = local(_cohen(sample_stats(t, with_grid)))
    out = s.join(F.broadcast(t.ks_mw), "feature").join(F.broadcast(hist_metrics(t)), "feature", "left")
    flat = F.col("lo") == F.col("hi")
    return (out.withColumn("overlap", F.when(flat, 1.0).otherwise(F.coalesce("overlap", F.lit(0.0))))
               .withColumn("jsd", F.when(flat, 0.0).otherwise(F.col("jsd")))
               .withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0))


def similarity_class(overlap):
    return (F.when(overlap > 0.8, "Similar")
            .when(overlap < 0.5, "Substantially Different")
            .otherwise("Moderately Different"))


def comparison_stats(t: Tables) -> DataFrame:
    """T11 without p-values (every column SQL-checkable)."""
    c = _core(t)
    return c.select(
        F.col("feature").alias("Feature"),
        (F.col("mean1") - F.col("mean2")).alias("Mean_Diff"),
        (F.col("median1") - F.col("median2")).alias("Median_Diff"),
        F.col("cohen_d").alias("Cohen_d"),
        F.col("overlap").alias("Overlap_Coefficient"),
        F.col("ks").alias("KS_Stat"),
        F.col("u1").alias("MW_Stat"),
        similarity_class(F.col("overlap")).alias("Similarity"))


def _ks_p(c: DataFrame, method: str) -> DataFrame:
    """T4 by ``RunSpec.ks_method``; the exact law takes work for each feature, so features are dealt to tasks."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    if method == "exact":
        return c.repartition("feature").withColumn("ks_p", ks_two_sample_sf_udf(F.col("ks"), n1, n2))
    if method == "one_sample":
        return c.withColumn("ks_p", kolmogorov_sf_udf(F.col("ks"), F.round(n1 * n2 / (n1 + n2))))
    raise ValueError(f"unknown ks_method: {method}")


def ks_test(t: Tables, method: str | None = None) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic and its p-value (``method``: as ``RunSpec.ks_method``, its default)."""
    c = sample_stats(t).select("feature", "n1", "n2").join(F.broadcast(t.ks_mw), "feature")
    return _ks_p(c, method or t.spec.ks_method).select(
        F.col("feature").alias("Feature"), F.col("n1").alias("N1"), F.col("n2").alias("N2"),
        F.col("ks").alias("KS_Statistic"), F.col("ks_p").alias("KS_pvalue"))


def _p_values(c: DataFrame, method: str) -> DataFrame:
    """T4 (``_ks_p``) and T6 (normal approximation, tie + 1/2 continuity)."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    c = _ks_p(c, method)
    n = n1 + n2
    u = F.greatest(F.col("u1"), n1 * n2 - F.col("u1"))
    s = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (u - n1 * n2 / 2.0 - 0.5) / s
    mw_p = F.least(F.lit(1.0), 2.0 * norm_sf_udf(z))
    return c.withColumn("mw_p", mw_p)


def comparison_report(t: Tables) -> DataFrame:
    """The full comparison report (10 columns)."""
    c = _p_values(_core(t), t.spec.ks_method)
    return c.select(
        F.col("feature").alias("Feature"),
        (F.col("mean1") - F.col("mean2")).alias("Mean_Diff"),
        (F.col("median1") - F.col("median2")).alias("Median_Diff"),
        F.col("cohen_d").alias("Cohen_d"),
        F.col("overlap").alias("Overlap_Coefficient"),
        F.col("ks").alias("KS_Stat"), F.col("ks_p").alias("KS_pvalue"),
        F.col("u1").alias("MW_Stat"), F.col("mw_p").alias("MW_pvalue"),
        similarity_class(F.col("overlap")).alias("Similarity")).orderBy("Feature")


def similarity_score(jsd, overlap, ks):
    """100 * (0.4 (1 - min(JSD, 1)) + 0.4 overlap + 0.2 (1 - KS))."""
    return ((1 - F.least(jsd, F.lit(1.0))) * 0.4 + overlap * 0.4 + (1 - ks) * 0.2) * 100


def similarity_stats(t: Tables) -> DataFrame:
    """T14 without the KS p-value (SQL-checkable)."""
    c = _core(t, with_grid=True)
    c = c.join(F.broadcast(quantile_correlation(t, c)), "feature", "left")
    return c.select(
        F.col("feature").alias("Feature"),
        F.col("ks").alias("KS_Statistic"),
        F.col("cohen_d").alias("Cohens_d"),
        F.col("jsd").alias("JS_Divergence"),
        F.col("qcorr").alias("Quantile_Correlation"),
        similarity_score(F.col("jsd"), F.col("overlap"), F.col("ks")).alias("Similarity_Score"))


def similarity_report(t: Tables) -> DataFrame:
    """7 columns, sorted by score descending (feature breaks ties)."""
    c = _core(t, with_grid=True)
    c = _p_values(c, t.spec.ks_method).join(F.broadcast(quantile_correlation(t, c)), "feature", "left")
    return c.select(
        F.col("feature").alias("Feature"),
        F.col("ks").alias("KS_Statistic"), F.col("ks_p").alias("KS_pvalue"),
        F.col("cohen_d").alias("Cohens_d"),
        F.col("jsd").alias("JS_Divergence"),
        F.col("qcorr").alias("Quantile_Correlation"),
        similarity_score(F.col("jsd"), F.col("overlap"), F.col("ks")).alias("Similarity_Score"),
    ).orderBy(F.desc("Similarity_Score"), "Feature")


def histogram_table(t: Tables) -> DataFrame:
    """The dense shared-range histogram (feature, bin, n1, n2, left edge)."""
    h = t.hist
    return h.select(F.col("feature").alias("Feature"), F.col("bin").alias("Bin"),
                    F.col("c1").alias("Count_1"), F.col("c2").alias("Count_2"),
                    (F.col("bin") * F.col("step") + F.col("lo")).alias("Left_Edge"))
