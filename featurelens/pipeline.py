"""The whole analysis as one call: ``run(d1, d2, spec) -> {report name: DataFrame}``.

Stage order follows the reference pipeline: matching, overview,
missingness, distributions, plausibility, extremes, normality, outliers,
correlations, redundancy, dimensionality, relationships, batch effect,
comparisons, similarity, paired validation (paired mode only), quality score,
conclusions.  Shared tables (long form, value counts, ranks, moments, percentiles) are made once in ``Tables``; the
per-feature reports that others read (missingness, plausibility, univariate outliers, similarity statistics, constancy flags,
paired statistics, quality) are finished once and passed on.  ``write`` sends every report to a sink once and frees what the
run holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import (batch, compare, correlation, distribution, multivariate, normality, outliers, paired,
                        plotdata, profile, quality, redundancy)
from .plans.tables import Tables
from .sources.loader import prepare
from .sources.sink import write_all
from .spec import RunSpec


class Reports(dict):
    """Report name -> DataFrame, with the tables that they share."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def release(self) -> None:
        self.tables.release()


def run(d1: DataFrame, d2: DataFrame, spec: RunSpec, heavy: bool = True) -> Reports:
    """All reports of one run.  ``heavy=False`` skips Kendall, the forest models and PCA."""
    p = prepare(d1, d2, spec)
    t = Tables(p)
    r = Reports(t)
    if spec.is_paired:
        r["record_matching"] = paired.record_matching(p)
    r["overview"] = profile.overview(p)
    r["feature_summary"] = profile.feature_summary(p)
    r["missingness"] = t.report("missingness", lambda: profile.missingness(p))
    r["missingness_correlation"] = profile.missingness_correlation(p)
    r["distribution_statistics"] = distribution.distribution_stats(t)
    r["plausibility"] = t.report("plausibility", lambda: distribution.plausibility(t))
    r["feature_extremes"] = distribution.extremes(t)
    r["normality"] = normality.normality_report(t)
    uni = t.report("univariate_outliers", lambda: outliers.univariate_outliers(t))
    r["outlier_summary"] = multivariate.multivariate_outliers(t).unionByName(uni) if heavy else uni
    mats = correlation.correlation_matrices(t, kendall=heavy)
    r["correlation_matrices"] = mats
    r["high_correlation_pairs"] = correlation.high_correlation_pairs(t, mats)
    r["feature_redundancy"] = redundancy.redundancy_report(t)
    if heavy:
        r["pca_loadings"] = multivariate.pca_loadings(t)
        r["pca_variance"] = multivariate.pca_variance(t)
        imp, rep = batch.batch_effect(t)
        r["batch_effect_importance"] = imp
        r["batch_effect_report"] = rep
    r["relationships"] = plotdata.relationships(t)
    r["comparison"] = compare.comparison_report(t)
    r["similarity"] = compare.similarity_report(t)
    if spec.is_paired:
        r["paired_validation"] = paired.paired_report(t)
        r["paired_summary"] = paired.paired_summary(t, t.report("paired_stats", lambda: paired.paired_stats(t)))
    r["feature_quality"] = quality.finished_quality(t)
    r["conclusions"] = quality.conclusions(t)
    return r


def write(reports: dict, root: str, spec: RunSpec, fmt: str = "parquet") -> list:
    """Write every report once under ``root/<name>/mode=<mode>``."""
    written = write_all(reports, root, spec.mode, fmt)
    if isinstance(reports, Reports):
        reports.release()
    return written
