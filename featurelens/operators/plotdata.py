"""Plot-ready aggregates (G1-G7) and relationship fits (M4).

Drawing is not built; these are the tables a chart reads.  Every output is
bounded per feature (bins, grid points, quantiles), so it can be collected
for plotting whatever the table size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shape import numpy_bin
from ..plans.tables import QGRID, Tables, ds_name
from .compare import feature_stats

# Feature pairs of the reference's relationship view.
DEFAULT_RELATIONSHIP_PAIRS = (
    ("RR_Mean_Global", "QRS_Dur_Global"),
    ("S_Amp_V1", "R_Amp_V5"),
    ("ST_Elev_V2", "ST_Elev_V3"),
    ("QRS_Dur_Global", "R_Amp_I"),
    ("Q_Amp_III", "T_Amp_III"),
)


def density_histogram(t: Tables, bins: int = 50) -> DataFrame:
    """G1: per dataset and feature, ``bins`` equal bins over that dataset's own range."""
    rng = t.moments.select("ds", "feature", F.col("min").alias("lo"), F.col("max").alias("hi"), "n") \
                   .where(F.col("lo") < F.col("hi"))
    c = (t.long.join(F.broadcast(rng), ["ds", "feature"])
         .groupBy("ds", "feature", numpy_bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
         .agg(F.count(F.lit(1)).alias("count")))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / bins
    left = F.col("bin") * step + F.col("lo")
    right = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise((F.col("bin") + 1) * step + F.col("lo"))
    j = grid.join(F.broadcast(c), ["ds", "feature", "bin"], "left")
    cnt = F.coalesce(F.col("count"), F.lit(0))
    return j.select(ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"), F.col("bin").alias("Bin"),
                    left.alias("Left_Edge"), right.alias("Right_Edge"), cnt.alias("Count"),
                    (cnt / (right - left) / F.col("n")).alias("Density"))


def kde_curve(t: Tables, grid_points: int = 200, cut: float = 3.0, bins: int = 512) -> DataFrame:
    """G2 (cut=3) / G4 (cut=0, violin): binned Gaussian KDE, Scott bandwidth n^(-1/5) * sample SD.

    The data are first binned (``bins`` per feature, counts at bin centres);
    the density at each grid point sums the kernel over the bins — an
    equi-join on (dataset, feature) of two parameter-bounded tables.
    """
    m = t.moments.where((F.col("n") > 1) & (F.col("var_samp") > 0)).select(
        "ds", "feature", "n", F.col("min").alias("lo"), F.col("max").alias("hi"),
        (F.pow(F.col("n").cast("double"), -0.2) * F.sqrt("var_samp")).alias("bw"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = (t.long.join(F.broadcast(m.select("ds", "feature", "lo", "hi")), ["ds", "feature"])
         .groupBy("ds", "feature", numpy_bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
         .agg(F.count(F.lit(1)).alias("c")))
    b = b.join(F.broadcast(m), ["ds", "feature"]).select(
        "ds", "feature", "c", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("centre"))
    g0 = F.col("lo") - cut * F.col("bw")
    g1 = F.col("hi") + cut * F.col("bw")
    grid = m.select("ds", "feature", "n", "bw", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("k"),
                    g0.alias("g0"), g1.alias("g1"))
    grid = grid.withColumn("x", F.col("g0") + F.col("k") * (F.col("g1") - F.col("g0")) / (grid_points - 1))
    u = (F.col("x") - F.col("centre")) / F.col("bw")
    dens = F.sum(F.col("c") * F.exp(-0.5 * u * u)) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    out = grid.join(b, ["ds", "feature"]).groupBy("ds", "feature", "k", "x", "n", "bw").agg(dens.alias("Density"))
    return out.select(ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"), F.col("k").alias("Point"),
                      F.col("x").alias("X"), "Density")


def box_summary(t: Tables, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside the 1.5 IQR fences) and fence outliers."""
    p = t.percentiles.select("ds", "feature", "p25", "p50", "p75")
    lo = F.col("p25") - whisker * (F.col("p75") - F.col("p25"))
    hi = F.col("p75") + whisker * (F.col("p75") - F.col("p25"))
    v = F.col("value")
    j = t.long.join(F.broadcast(p), ["ds", "feature"])
    a = j.groupBy("ds", "feature", "p25", "p50", "p75").agg(
        F.min(F.when(v >= lo, v)).alias("Whisker_Low"), F.max(F.when(v <= hi, v)).alias("Whisker_High"),
        F.count_if((v < lo) | (v > hi)).alias("Outliers"))
    return a.select(ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"),
                    F.col("p25").alias("Q1"), F.col("p50").alias("Median"), F.col("p75").alias("Q3"),
                    "Whisker_Low", "Whisker_High", "Outliers")


def ecdf_points(t: Tables, points: int = 100) -> DataFrame:
    """ECDF (value, share <= value) thinned to the values where the share crosses a 1/points step."""
    parts = []
    for d in (1, 2):
        w, c, tot = f"n{d}", f"cum_n{d}", f"tot_n{d}"
        r = t.rk.where(F.col(w) > 0)
        hit = F.floor(F.col(c) * points / F.col(tot)) > F.floor((F.col(c) - F.col(w)) * points / F.col(tot))
        parts.append(r.where(hit).select(F.lit(d).alias("ds"), "feature", "value",
                                         (F.col(c) / F.col(tot)).alias("ecdf")))
    u = parts[0].unionByName(parts[1])
    return u.select(ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"),
                    F.col("value").alias("Value"), F.col("ecdf").alias("ECDF"))


def two_sample_qq(t: Tables) -> DataFrame:
    """The 100 quantiles (0.01..0.99) of both datasets side by side."""
    st = feature_stats(t, with_grid=True)
    z = st.select("feature", F.posexplode(F.arrays_zip(F.col("grid1").alias("a"), F.col("grid2").alias("b"))))
    probs = F.array(*[F.lit(q) for q in QGRID])
    return z.select(F.col("feature").alias("Feature"), F.element_at(probs, F.col("pos") + 1).alias("Q"),
                    F.col("col.a").alias("Quantile_1"), F.col("col.b").alias("Quantile_2"))


def relationships(t: Tables, pairs=None) -> DataFrame:
    """M4: least-squares fit y ~ x per dataset for each configured pair present in the data (n >= 10)."""
    pairs = pairs if pairs is not None else (t.spec.relationship_pairs or DEFAULT_RELATIONSHIP_PAIRS)
    have = set(t.p.features)
    parts = []
    for d, df in ((1, t.p.d1), (2, t.p.d2)):
        for x, y in pairs:
            if x not in have or y not in have:
                continue
            xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
            parts.append(df.agg(F.regr_count(yc, xc).alias("N"), F.regr_slope(yc, xc).alias("Slope"),
                                F.regr_intercept(yc, xc).alias("Intercept"), F.regr_r2(yc, xc).alias("R2"))
                         .select(F.lit(d).alias("ds"), F.lit(x).alias("X"), F.lit(y).alias("Y"), "*"))
    if not parts:
        return t.p.d1.sparkSession.createDataFrame(
            [], "Dataset string, X string, Y string, N long, Slope double, Intercept double, R2 double")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    k = t.spec.thresholds.min_compare_n
    return u.where(F.col("N") >= k).select(ds_name(t.spec).alias("Dataset"), "X", "Y", "N", "Slope", "Intercept", "R2")
