"""Normality.

* N3 D'Agostino-Pearson K^2 is column algebra on (n, g1, g2) from the shared
  moments (D'Agostino 1970, Anscombe & Glynn 1983); p = exp(-K^2 / 2).
* N2 Anderson-Darling A^2 on all values: with the 1-based ranks j of the
  sorted values, A^2 = -n - (1/n) sum[(2j-1) ln Phi(z_j) + (2n+1-2j) ln(1-Phi(z_j))],
  and a tie block of c values starting after rank a contributes the closed
  sums (a+c)^2 - a^2 and c(2n+1) - [(a+c)(a+c+1) - a(a+1)]; so A^2 is one
  aggregate over the rank table with ln Phi from a vectorised pandas UDF.
* N1 Shapiro-Wilk over all values: sums over the rank table, chunked by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shapiro import chunk_sums, royston
from ..functions.special import log_norm_cdf_udf, norm_ppf_udf
from ..plans.rank import cumulate, quantiles
from ..plans.tables import Tables, ds_name

# Fixed value: Stephens' 5% critical constant for the normal case (estimated mean and variance).
AD_CRIT_5PCT = 0.787
#: Ranks of one value that are summed together.
RANK_CHUNK = 65_536


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def k2(t: Tables) -> DataFrame:
    """(ds, feature, n, skew, kurt, z_skew, z_kurt, k2, k2_p) for n >= guard."""
    k = t.spec.thresholds.min_normality_n
    m = t.moments.where(F.col("n") >= k)
    n = F.col("n").cast("double")
    g1, g2 = F.col("skew"), F.col("kurt")
    # skewtest
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    yy = F.when(y == 0, F.lit(1.0)).otherwise(y)
    z1 = delta * F.log(yy / alpha + F.sqrt((yy / alpha) * (yy / alpha) + 1))
    # kurtosistest
    b2 = g2 + 3
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    den = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.when(den == 0, F.lit(None).cast("double")).otherwise(
        F.signum(den) * F.pow((1 - 2.0 / a) / F.abs(den), 1 / 3.0))
    z2 = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    stat = z1 * z1 + z2 * z2
    return m.select("ds", "feature", "n", "skew", "kurt", z1.alias("z_skew"), z2.alias("z_kurt"),
                    stat.alias("k2"), F.exp(-stat / 2).alias("k2_p"))


def anderson_darling(t: Tables) -> DataFrame:
    """(ds, feature, ad, ad_crit) over all non-null values (sample SD)."""
    k = t.spec.thresholds.min_normality_n
    m = t.moments.where(F.col("n") >= k).select("ds", "feature", "n", "mean", "var_samp")
    parts = []
    rk = t.rk
    for d in (1, 2):
        w, c = f"n{d}", f"cum_n{d}"
        parts.append(rk.where(F.col(w) > 0).select("feature", "value", F.col(w).alias("c"),
                                                  (F.col(c) - F.col(w)).alias("a"), F.lit(d).alias("ds")))
    r = parts[0].unionByName(parts[1]).join(F.broadcast(m), ["ds", "feature"])
    z = (F.col("value") - F.col("mean")) / F.sqrt(F.col("var_samp"))
    r = r.withColumn("z", z).where(F.col("var_samp") > 0)
    r = r.withColumn("lcdf", log_norm_cdf_udf(F.col("z"))).withColumn("lsf", log_norm_cdf_udf(-F.col("z")))
    a, c, n = F.col("a").cast("double"), F.col("c").cast("double"), F.col("n").cast("double")
    s_lo = (a + c) * (a + c) - a * a
    s_hi = c * (2 * n + 1) - ((a + c) * (a + c + 1) - a * (a + 1))
    agg = r.groupBy("ds", "feature", "n").agg(F.sum(F.col("lcdf") * s_lo + F.col("lsf") * s_hi).alias("_s"))
    nn = F.col("n").cast("double")
    crit = F.bround(F.lit(AD_CRIT_5PCT) / (1.0 + 4.0 / nn - 25.0 / (nn * nn)), 3)
    return agg.select("ds", "feature", (-nn - F.col("_s") / nn).alias("ad"), crit.alias("ad_crit"))


@F.pandas_udf(_doubles("one", "two"))
def _order_sums(first: pd.Series, stop: pd.Series, n: pd.Series) -> pd.DataFrame:
    one, two = chunk_sums(first.to_numpy(np.int64), stop.to_numpy(np.int64), n.to_numpy(np.float64))
    return pd.DataFrame({"one": one, "two": two})


@F.pandas_udf(_doubles("sw", "sw_p"))
def _royston(n: pd.Series, dot: pd.Series, mm: pd.Series, outer: pd.Series, inner: pd.Series, ss: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([royston(*r) for r in zip(n, dot, mm, outer, inner, ss, strict=True)], columns=["sw", "sw_p"])


def shapiro(t: Tables) -> DataFrame:
    """(ds, feature, sw, sw_p) over all values.

    Each distinct value stands at an interval of ranks; intervals are cut into chunks of ``RANK_CHUNK`` ranks,
    so that a value that very many rows share is spread over tasks.
    """
    k = t.spec.thresholds.min_normality_n
    sides = [t.rk.where(F.col(f"n{d}") > 0).select(F.lit(d).alias("ds"), "feature", "value",
                                                   (F.col(f"cum_n{d}") - F.col(f"n{d}")).alias("lo"),
                                                   F.col(f"cum_n{d}").alias("hi")) for d in (1, 2)]
    base = t.moments.where(F.col("n") >= k).select("ds", "feature", "n", "mean", "var_pop")
    rows = sides[0].unionByName(sides[1]).join(base, ["ds", "feature"])
    rows = rows.withColumn("first", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(RANK_CHUNK).cast("long"))))
    rows = rows.withColumn("stop", F.least(F.col("first") + RANK_CHUNK, F.col("hi")))
    rows = rows.withColumn("s", _order_sums("first", "stop", F.col("n").cast("double")))

    def at(rank):  # the value at a 0-based rank
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("value")))

    n = F.col("n")
    g = rows.groupBy("ds", "feature").agg(
        F.first("n").cast("double").alias("n"), F.sum((F.col("value") - F.col("mean")) * F.col("s.one")).alias("dot"),
        F.sum("s.two").alias("mm"), (at(n - 1) - at(F.lit(0))).alias("outer"), (at(n - 2) - at(F.lit(1))).alias("inner"),
        (F.first("n") * F.first("var_pop")).alias("ss"))
    return g.withColumn("r", _royston("n", "dot", "mm", "outer", "inner", "ss")).select("ds", "feature", "r.sw", "r.sw_p")


def normality_tests(t: Tables) -> DataFrame:
    """K^2 and the practical rule (SQL-checkable part of the normality report)."""
    th = t.spec.thresholds
    r = k2(t)
    practical = (F.abs(F.col("skew")) < th.normality_skew_threshold) & (F.abs(F.col("kurt")) < th.normality_kurtosis_threshold)
    return r.select(ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"), F.col("n").alias("N"),
                    F.col("skew").alias("Skewness"), F.col("kurt").alias("Kurtosis"),
                    F.col("k2").alias("DAgostino_K2_Stat"), F.col("k2_p").alias("DAgostino_K2_pvalue"),
                    practical.alias("Practically_Normal"))


def normality_report(t: Tables) -> DataFrame:
    """The 14-column normality report."""
    th = t.spec.thresholds
    base = k2(t)
    j = (base.join(anderson_darling(t), ["ds", "feature"], "left")
         .join(shapiro(t), ["ds", "feature"], "left"))
    alpha = th.normality_alpha
    practical = (F.abs(F.col("skew")) < th.normality_skew_threshold) & (F.abs(F.col("kurt")) < th.normality_kurtosis_threshold)
    ad_ok = F.coalesce(F.col("ad") < F.col("ad_crit"), F.lit(False))
    formal = (F.coalesce(F.col("sw_p") > alpha, F.lit(False)) & ad_ok
              & F.coalesce(F.col("k2_p") > alpha, F.lit(False)))
    return j.select(
        ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"), F.col("n").alias("N"),
        F.col("skew").alias("Skewness"), F.col("kurt").alias("Kurtosis"),
        F.col("sw").alias("Shapiro_Wilk_Stat"), F.col("sw_p").alias("Shapiro_Wilk_pvalue"),
        F.col("ad").alias("Anderson_Darling_Stat"), ad_ok.alias("AD_Is_Gaussian_5pct"),
        F.col("k2").alias("DAgostino_K2_Stat"), F.col("k2_p").alias("DAgostino_K2_pvalue"),
        practical.alias("Practically_Normal"), formal.alias("Formal_Consensus"),
        (practical if t.spec.normality_rule == "practical" else formal).alias("Approx_Gaussian"))


def qq_points(t: Tables, points: int = 100) -> DataFrame:
    """Normal Q-Q plot data thinned to ``points`` per group.

    Ordered values at evenly spaced ranks (exact, rank table) against
    Filliben's normal order-statistic medians at the same ranks.
    """
    probs = [i / (points - 1) for i in range(points)]
    q = t.quantiles(probs)
    n = t.moments.select("ds", "feature", "n")
    j = q.join(F.broadcast(n), ["ds", "feature"])
    nn = F.col("n").cast("double")
    i = F.col("q") * (nn - 1) + 1                       # 1-based (fractional) rank
    u = (F.when(i <= 1, -F.expm1(F.log(F.lit(0.5)) / nn))
         .when(i >= nn, F.pow(F.lit(0.5), 1 / nn))
         .otherwise((i - 0.3175) / (nn + 0.365)))
    return j.select(ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"),
                    F.round(F.col("q") * (points - 1)).cast("int").alias("Point"),
                    norm_ppf_udf(u).alias("Theoretical"), F.col("quantile").alias("Ordered"))
