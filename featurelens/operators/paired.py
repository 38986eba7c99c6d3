"""Record matching (P5-P9) and record-level agreement.

``PL`` = (id, feature, v1, v2) holds one row per matched key and feature with
both values present.  Every moment-based metric is one aggregate over it;
the rank-based ones (median difference, Wilcoxon, Spearman) use the shared
two-level rank kernel on value counts of PL, so no feature is ever gathered
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import corr_from_parts, corr_parts
from ..functions.special import norm_sf_udf, t_sf2_udf, wilcoxon_exact_p_udf
from ..plans.rank import cumulate, group_quantiles
from ..plans.tables import Tables
from ..sources.loader import Prepared


def record_matching(p: Prepared) -> DataFrame:
    """8-row (Metric, Value) report on the raw inputs (before dedup)."""
    s = p.spec
    idc = p.id_col

    def side(df, flag):
        return df.where(F.col(idc).isNotNull()).select(F.col(idc).alias("id")).distinct().withColumn(flag, F.lit(1))

    ids = side(p.raw1, "in1").join(side(p.raw2, "in2"), "id", "full_outer")
    m = ids.agg(F.count_if(F.col("in1").isNotNull() & F.col("in2").isNotNull()).alias("matched"),
                F.count_if(F.col("in1").isNotNull() & F.col("in2").isNull()).alias("only1"),
                F.count_if(F.col("in1").isNull() & F.col("in2").isNotNull()).alias("only2"),
                F.count_if(F.col("in1").isNotNull()).alias("ids1"))

    def counts(df):
        c = F.col(idc)
        return df.agg(F.count(F.lit(1)).alias("n"),
                      (F.count(F.lit(1)) - F.count_distinct(c) - F.max(F.when(c.isNull(), 1).otherwise(0))).alias("dup"))

    a = counts(p.raw1).select(F.lit(0).alias("_k"), F.col("n").alias("n1"), F.col("dup").alias("dup1"))
    b = counts(p.raw2).select(F.lit(0).alias("_k"), F.col("n").alias("n2"), F.col("dup").alias("dup2"))
    r = m.withColumn("_k", F.lit(0)).join(F.broadcast(a), "_k").join(F.broadcast(b), "_k")
    pct = F.when(F.col("ids1") > 0, F.bround(F.col("matched") / F.col("ids1") * 100, 2)).otherwise(F.lit(0.0))
    d1, d2 = s.dataset1_name, s.dataset2_name
    items = [(f"Records in {d1}", F.col("n1")), (f"Records in {d2}", F.col("n2")),
             ("Successfully matched", F.col("matched")),
             (f"Present only in {d1}", F.col("only1")), (f"Present only in {d2}", F.col("only2")),
             (f"Duplicate IDs in {d1}", F.col("dup1")), (f"Duplicate IDs in {d2}", F.col("dup2")),
             ("Match percentage (%)", pct)]
    arr = F.array(*[F.struct(F.lit(k).alias("Metric"), v.cast("double").alias("Value")) for k, v in items])
    return r.select(F.explode(arr).alias("r")).select("r.*")


def _moments(pl: DataFrame) -> DataFrame:
    d = F.col("v2") - F.col("v1")
    return pl.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_d"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.avg(F.when(F.col("v1") != 0, F.abs(d / F.col("v1")))) * 100).alias("mape"),
        F.stddev_samp(d).alias("sd_d"),
        F.var_samp("v1").alias("s1"), F.var_samp("v2").alias("s2"), F.covar_samp("v1", "v2").alias("c12"),
        *corr_parts(F.col("v1"), F.col("v2"), "pr"))


def _median_diff(t: Tables, pl: DataFrame) -> DataFrame:
    dv = pl.groupBy("feature", (F.col("v2") - F.col("v1")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    q = group_quantiles(t.hold(dv), ["feature"], "d", ["n"], [0.5], t.spec.rank_buckets)
    return q.select("feature", F.col("quantile").alias("median_d"))


def _wilcoxon(t: Tables, pl: DataFrame) -> DataFrame:
    """V7: W = min(R+, R-) over non-zero differences with average ranks of |d|; tie term."""
    d = F.col("v2") - F.col("v1")
    a = (pl.where(d != 0).groupBy("feature", F.abs(d).alias("a"))
         .agg(F.count_if(d > 0).alias("np"), F.count_if(d < 0).alias("nn")))
    a = a.withColumn("t", F.col("np") + F.col("nn"))
    rk = cumulate(t.hold(a), ["feature"], "a", ["t"], t.spec.rank_buckets)
    avg_rank = F.col("cum_t") - F.col("t") + (F.col("t") + 1) / 2.0
    return rk.groupBy("feature").agg(
        F.sum(F.col("np") * avg_rank).alias("r_plus"), F.sum(F.col("nn") * avg_rank).alias("r_minus"),
        F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("w_tie"),
        F.sum("t").alias("w_n"))


def _avg_ranks(t: Tables, pl: DataFrame, col: str) -> DataFrame:
    """(feature, <col>, r_<col>) average rank of each value within the paired rows."""
    vc = pl.groupBy("feature", col).agg(F.count(F.lit(1)).alias("c"))
    rk = cumulate(t.hold(vc), ["feature"], col, ["c"], t.spec.rank_buckets)
    return rk.select("feature", col, (F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2.0).alias(f"r_{col}"))


def _spearman(t: Tables, pl: DataFrame) -> DataFrame:
    """V9: Pearson r of the average ranks (joined back on (feature, value))."""
    j = pl.join(_avg_ranks(t, pl, "v1"), ["feature", "v1"]).join(_avg_ranks(t, pl, "v2"), ["feature", "v2"])
    return j.groupBy("feature").agg(*corr_parts(F.col("r_v1"), F.col("r_v2"), "sp")) \
            .select("feature", corr_from_parts("sp").alias("spearman"))


def agreement(icc, mape):
    """Class from ICC and MAPE (NULL comparisons fall through, like NaN)."""
    return (F.when((icc >= 0.95) & (mape < 5), "Excellent")
            .when((icc >= 0.90) & (mape < 10), "Good")
            .when((icc >= 0.75) & (mape < 20), "Moderate")
            .when(icc >= 0.50, "Fair")
            .otherwise("Poor"))


def _core(t: Tables) -> DataFrame:
    pl = t.paired
    k = t.spec.thresholds.min_compare_n
    m = _moments(pl).where(F.col("n") >= k)
    out = (m.join(_median_diff(t, pl), "feature", "left")
           .join(_wilcoxon(t, pl), "feature", "left")
           .join(_spearman(t, pl), "feature", "left"))
    n = F.col("n").cast("double")
    denom = F.col("s1") + F.col("s2")
    icc = F.when((F.col("n") >= 3) & (denom != 0), 2 * F.col("c12") / denom)
    tt = F.when(F.col("sd_d") > 0, -F.col("mean_d") / (F.col("sd_d") / F.sqrt(n)))
    return (out.withColumn("icc", icc).withColumn("pearson", corr_from_parts("pr"))
               .withColumn("t_stat", tt)
               .withColumn("w_stat", F.when(F.col("w_n") > 0, F.least("r_plus", "r_minus"))))


def _shared_core(t: Tables) -> DataFrame:
    return t.report("paired_core", lambda: _core(t))


def paired_stats(t: Tables, core: DataFrame | None = None) -> DataFrame:
    """V13 without p-values (SQL-checkable); rounding as the reference.  ``core``: where it is built already."""
    c = _shared_core(t) if core is None else core
    r6 = lambda x: F.bround(x, 6)
    loa = 1.96 * F.col("sd_d")
    return c.select(
        F.col("feature").alias("Feature"), F.col("n").alias("N_Paired"),
        r6(F.col("mean_d")).alias("Mean_Diff"), r6(F.col("median_d")).alias("Median_Diff"),
        r6(F.col("mae")).alias("MAE"), r6(F.col("rmse")).alias("RMSE"),
        F.bround(F.col("mape"), 4).alias("MAPE_pct"),
        F.bround(F.col("t_stat"), 4).alias("Paired_t_stat"),
        F.bround(F.col("w_stat"), 4).alias("Wilcoxon_stat"),
        r6(F.col("pearson")).alias("Pearson_r"), r6(F.col("spearman")).alias("Spearman_r"),
        r6(F.col("icc")).alias("ICC"),
        r6(F.col("mean_d")).alias("BlandAltman_MeanDiff"), r6(F.col("sd_d")).alias("BlandAltman_SD"),
        r6(F.col("mean_d") + loa).alias("BlandAltman_LoA_Upper"),
        r6(F.col("mean_d") - loa).alias("BlandAltman_LoA_Lower"),
        agreement(F.col("icc"), F.col("mape")).alias("Agreement"))


def paired_report(t: Tables) -> DataFrame:
    """The 21-column paired validation report, sorted by ICC descending.

    p-values: Student t for the paired t-test, Pearson and Spearman (df n-1,
    n-2, n-2); Wilcoxon by ``RunSpec.wilcoxon_method``: "normal" (tie-corrected, without
    continuity correction) or "exact" (for untied differences; its work grows with n^3).
    """
    c = _shared_core(t)
    n = F.col("n").cast("double")
    r_p = F.col("pearson")
    r_s = F.col("spearman")
    t_p = F.when(F.abs(r_p) < 1, r_p * F.sqrt((n - 2) / (1 - r_p * r_p)))
    t_s = F.when(F.abs(r_s) < 1, r_s * F.sqrt((n - 2) / ((r_s + 1) * (1 - r_s))))
    wn = F.col("w_n").cast("double")
    se = F.sqrt((wn * (wn + 1) * (2 * wn + 1) - 0.5 * F.col("w_tie")) / 24.0)
    z = (F.col("w_stat") - wn * (wn + 1) / 4.0) / se
    c = (c.withColumn("t_p", t_sf2_udf(F.col("t_stat"), n - 1))
          .withColumn("pear_p", F.when(F.abs(r_p) >= 1, F.lit(0.0)).otherwise(t_sf2_udf(t_p, n - 2)))
          .withColumn("spear_p", F.when(F.abs(r_s) >= 1, F.lit(0.0)).otherwise(t_sf2_udf(t_s, n - 2)))
          .withColumn("w_p", wilcoxon_exact_p_udf(F.col("w_stat"), F.col("w_n")) if t.spec.wilcoxon_method == "exact" else
                      F.when(se > 0, F.least(F.lit(1.0), 2.0 * norm_sf_udf(F.abs(z))))))
    s = paired_stats(t, c).drop("Agreement")
    extra = c.select(F.col("feature").alias("Feature"), F.col("t_p").alias("Paired_t_pvalue"),
                     F.col("w_p").alias("Wilcoxon_pvalue"), F.col("pear_p").alias("Pearson_pvalue"),
                     F.col("spear_p").alias("Spearman_pvalue"),
                     agreement(F.col("icc"), F.col("mape")).alias("Agreement"))
    cols = ["Feature", "N_Paired", "Mean_Diff", "Median_Diff", "MAE", "RMSE", "MAPE_pct", "Paired_t_stat",
            "Paired_t_pvalue", "Wilcoxon_stat", "Wilcoxon_pvalue", "Pearson_r", "Pearson_pvalue", "Spearman_r",
            "Spearman_pvalue", "ICC", "BlandAltman_MeanDiff", "BlandAltman_SD", "BlandAltman_LoA_Upper",
            "BlandAltman_LoA_Lower", "Agreement"]
    return s.join(extra, "Feature").select(*cols).orderBy(F.desc_nulls_last("ICC"), "Feature")


def paired_summary(t: Tables, stats: DataFrame | None = None) -> DataFrame:
    """(Metric, Value) over the rounded paired report (``stats``, where it is finished already)."""
    s = paired_stats(t) if stats is None else stats
    a = s.agg(F.count(F.lit(1)).cast("double").alias("Features analyzed"),
              F.avg("ICC").alias("Mean ICC"), F.median("ICC").alias("Median ICC"),
              F.avg("Pearson_r").alias("Mean Pearson r"), F.avg("MAE").alias("Mean MAE"),
              F.avg("MAPE_pct").alias("Mean MAPE"),
              *[F.count_if(F.col("Agreement") == k).cast("double").alias(f"{k} agreement")
                for k in ("Excellent", "Good", "Moderate", "Fair", "Poor")])
    arr = F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(f"`{c}`").alias("Value")) for c in a.columns])
    return a.select(F.explode(arr).alias("r")).select("r.*")


def _grid(pts: DataFrame, bins: int, names: tuple) -> DataFrame:
    """Counts of (a, b) points per feature on a bins x bins grid over their ranges."""
    rng = pts.groupBy("feature").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))

    def cell(v, lo, hi):
        return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins).cast("int"))) \
                .otherwise(F.lit(0))

    return (pts.join(F.broadcast(rng), "feature")
            .groupBy("feature", cell(F.col("a"), F.col("a0"), F.col("a1")).alias(names[0]),
                     cell(F.col("b"), F.col("b0"), F.col("b1")).alias(names[1]))
            .agg(F.count(F.lit(1)).alias("Points"))
            .withColumnRenamed("feature", "Feature"))


def bland_altman_density(t: Tables, bins: int = 50) -> DataFrame:
    """2-D density of (mean, difference) points per feature on a bins x bins grid."""
    pts = t.paired.select("feature", ((F.col("v1") + F.col("v2")) / 2).alias("a"), (F.col("v2") - F.col("v1")).alias("b"))
    return _grid(pts, bins, ("Mean_Bin", "Diff_Bin"))


def paired_scatter(t: Tables, bins: int = 50) -> DataFrame:
    """2-D density of (v1, v2) points per feature on a bins x bins grid, with the identity line's range: the least and greatest of
    both sides."""
    pts = t.paired.select("feature", F.col("v1").alias("a"), F.col("v2").alias("b"))
    line = t.paired.groupBy(F.col("feature").alias("Feature")).agg(
        F.min(F.least("v1", "v2")).alias("Line_Low"), F.max(F.greatest("v1", "v2")).alias("Line_High"))
    return _grid(pts, bins, ("Bin_1", "Bin_2")).join(F.broadcast(line), "Feature")
