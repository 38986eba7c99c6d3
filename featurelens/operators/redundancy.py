"""Redundancy: constant / near-constant flags and VIF.

VIF without intercept (uncentred R^2) on median-imputed columns equals
G_ii * (G^-1)_ii for the uncentred Gram matrix G = X'X, so the data pass is
one Gram scan; the p x p algebra runs on the driver (p^2 numbers, O(p^3)).  One pivoted Cholesky
factorisation of the scaled matrix finds a largest set of independent columns; each column left over is a
combination of them, and these combinations span the null space.  Columns that take part in one lie in the span of the
others: an infinite VIF, reported as 9999 with ``VIF_Is_Infinite``.  The others' VIFs are the diagonal of the inverse of the
independent block, which a left-over column without them does not change.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.gram import gram, gram_matrix
from ..plans.tables import Tables, ds_name

VIF_CAP = 9999.0


def feature_flags(t: Tables) -> DataFrame:
    """(ds, feature, is_constant, is_near_constant) over the numeric features.

    Constant: at most one distinct non-null value.  Near-constant: not
    constant and (sample variance < 1e-4 or the modal value holds >= 99%).
    """
    th = t.spec.thresholds
    m = t.moments.select("ds", "feature", "n", "min", "max", "var_samp")
    med = t.percentiles.select("ds", "feature", "p50")
    # a value holding >= 99% of the non-null rows is the median: count it exactly
    modal = (t.counts.join(F.broadcast(med), ["ds", "feature"]).groupBy("ds", "feature")
             .agg(F.sum(F.when(F.col("value") == F.col("p50"), F.col("n")).otherwise(0)).alias("k")))
    grid = t.p.d1.sparkSession.createDataFrame([(d, f) for d in (1, 2) for f in t.p.features],
                                              "ds int, feature string")
    j = grid.join(F.broadcast(m), ["ds", "feature"], "left").join(F.broadcast(modal), ["ds", "feature"], "left")
    const = F.coalesce(F.col("min") == F.col("max"), F.lit(True))
    share = F.when(F.col("n") > 0, F.col("k") / F.col("n"))
    near = (~const) & (F.coalesce(F.col("var_samp") < th.near_constant_variance, F.lit(False))
                       | F.coalesce(share >= th.near_constant_share, F.lit(False)))
    return j.select("ds", "feature", const.alias("is_constant"), near.alias("is_near_constant"))


def _flags(t: Tables) -> DataFrame:
    return t.report("feature_flags", lambda: feature_flags(t))


def pivoted_cholesky(s: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): ``s[order][:, order]`` is L L' up to residuals of at most ``tol``; L has a column per pivot."""
    rest, order = s.astype(float).copy(), np.arange(len(s))
    columns = []
    for k in range(len(s)):
        left = order[k:]
        best = k + int(np.argmax(np.diag(rest)[left]))
        order[[k, best]] = order[[best, k]]
        pivot = rest[order[k], order[k]]
        if pivot <= tol:
            break
        column = rest[:, order[k]] / np.sqrt(pivot)
        column[order[:k]] = 0.0
        columns.append(column)
        rest -= np.outer(column, column)
    found = np.array(columns).T.reshape(len(s), -1)
    return found[order], order


def vif_of_gram(g: np.ndarray, tol: float = 1e-10, part: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(vif, infinite) for every column of the uncentred Gram matrix ``g``.  ``tol``: share of a column's square that the others must
    leave for it to count as independent; ``part``: least weight in a combination of unit columns."""
    d = np.sqrt(np.clip(np.diag(g), 1e-300, None))
    low, order = pivoted_cholesky(g / np.outer(d, d), tol)
    r = low.shape[1]
    free, bound = order[:r], order[r:]
    inverse = np.linalg.inv(low[:r])  # lower triangular
    infinite = np.zeros(len(g), bool)
    infinite[bound] = True
    if len(bound):
        weights = inverse.T @ low[r:].T  # of the independent columns in each one left over
        infinite[free] = (np.abs(weights) > part).any(axis=1)
    vif = np.full(len(g), np.inf)
    vif[free] = (inverse * inverse).sum(axis=0)
    return np.where(infinite, np.inf, vif), infinite


def vif(t: Tables) -> DataFrame:
    """(ds, feature, vif, vif_is_infinite) for the non-constant features."""
    flags = {(r["ds"], r["feature"]): r["is_constant"] for r in _flags(t).collect()}
    med = {(r["ds"], r["feature"]): r["p50"] for r in t.percentiles.select("ds", "feature", "p50").collect()}
    spark = t.p.d1.sparkSession
    out = []
    for d, df in ((1, t.p.d1), (2, t.p.d2)):
        cols = [f for f in t.p.features if not flags.get((d, f), True)]
        if not cols:
            continue
        imputed = df.select(F.lit(d).alias("ds"),
                            *[F.coalesce(F.col(f).cast("double"), F.lit(med.get((d, f)))).alias(f) for f in cols])
        rows = gram(imputed, cols, shift=None, pairwise=False).collect()
        g = gram_matrix(rows, len(cols))[d]
        v, inf = vif_of_gram(g)
        out += [(d, f, float(x) if np.isfinite(x) else None, bool(b)) for f, x, b in zip(cols, v, inf)]
    return spark.createDataFrame(out, "ds int, feature string, vif double, vif_is_infinite boolean")


def redundancy_report(t: Tables) -> DataFrame:
    """Feature, VIF, VIF_Is_Infinite, Dataset, Is_Constant, Is_Near_Constant, Recommendation."""
    th = t.spec.thresholds
    fl = _flags(t)
    j = fl.join(vif(t), ["ds", "feature"], "left")
    v = F.when(F.col("is_constant"), F.lit(None).cast("double")) \
         .when(F.col("vif_is_infinite"), F.lit(VIF_CAP)).otherwise(F.col("vif"))
    rec = (F.when(F.col("is_constant"), "Remove (Constant)")
           .when(F.col("is_near_constant"), "Review for Removal (Near Constant)")
           .when(v > th.vif_high, "Review for Removal (High VIF)")
           .otherwise("Keep"))
    return j.select(F.col("feature").alias("Feature"), v.alias("VIF"),
                    F.when(F.col("is_constant"), F.lit(None).cast("boolean"))
                    .otherwise(F.col("vif_is_infinite")).alias("VIF_Is_Infinite"),
                    ds_name(t.spec).alias("Dataset"), F.col("is_constant").alias("Is_Constant"),
                    F.col("is_near_constant").alias("Is_Near_Constant"), rec.alias("Recommendation"))


def redundancy_flags(t: Tables) -> DataFrame:
    """R3 without VIF values (SQL-checkable): flags and the flag-based recommendation."""
    fl = feature_flags(t)
    rec = (F.when(F.col("is_constant"), "Remove (Constant)")
           .when(F.col("is_near_constant"), "Review for Removal (Near Constant)")
           .otherwise("Check VIF"))
    return fl.select(F.col("feature").alias("Feature"), ds_name(t.spec).alias("Dataset"),
                     F.col("is_constant").alias("Is_Constant"), F.col("is_near_constant").alias("Is_Near_Constant"),
                     rec.alias("Recommendation"))
