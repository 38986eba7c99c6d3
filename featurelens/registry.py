"""Registered queries: (operator report) x (fixture pair).

Each query reads the test tables through a fixture builder, prepares the pair
and returns one report DataFrame with float columns rounded to 9 significant
digits (``functions.columns.sig``).  ``ORACLES`` holds the SQL builder of each
query that DuckDB can express; queries without one are checked on rows only
and by property tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import sig
from .plans.tables import Tables, ds_name
from .sources.fixtures import FIXTURES
from .sources.loader import prepare

QUERIES: dict = {}
ORACLES: dict = {}
OPS: dict = {}  # name -> (fixture, operator, takes Prepared instead of Tables)


def rounded(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(sig(df[f.name]).alias(f.name))
        else:
            cols.append(df[f.name])
    return df.select(*cols)


def _make(fx: str, op, on_prepared: bool = False):
    def run(spark, sf_dir: str) -> DataFrame:
        d1, d2, spec = FIXTURES[fx](spark, sf_dir)
        p = prepare(d1, d2, spec)
        return rounded(op(p) if on_prepared else op(Tables(p)))
    run.__name__ = f"{op.__name__}_{fx}"
    run.__doc__ = op.__doc__
    return run


def register(name: str, fx: str, op, oracle=None, on_prepared: bool = False):
    QUERIES[name] = _make(fx, op, on_prepared)
    OPS[name] = (fx, op, on_prepared)
    if oracle is not None:
        ORACLES[name] = lambda: oracle(fx)


def _register_all():
    from oracle import sql as O

    from .operators import (batch, compare, correlation, distribution, lof, multivariate, normality, outliers, paired,
                            plotdata, profile, quality, redundancy)

    for fx in ("f2", "f3", "f9"):
        register(f"missingness_{fx}", fx, profile.missingness, O.missingness, on_prepared=True)
        register(f"feature_summary_{fx}", fx, profile.feature_summary, O.feature_summary, on_prepared=True)
        register(f"overview_{fx}", fx, profile.overview, O.overview, on_prepared=True)
    for fx in ("f2", "f9"):
        register(f"missingness_correlation_{fx}", fx, profile.missingness_correlation,
                 O.missingness_correlation, on_prepared=True)
        register(f"missingness_patterns_{fx}", fx, profile.missingness_patterns, O.missingness_patterns,
                 on_prepared=True)
    for fx in ("f1", "f2", "f8", "f9"):
        register(f"distribution_stats_{fx}", fx, distribution.distribution_stats, O.distribution_stats)
    for fx in ("f1", "f4", "f8", "f9"):
        register(f"plausibility_{fx}", fx, distribution.plausibility, O.plausibility)
    for fx in ("f1", "f2", "f8", "f11"):
        register(f"extremes_{fx}", fx, distribution.extremes, O.extremes)
    for fx in ("f1", "f2", "f8", "f9"):
        register(f"univariate_outliers_{fx}", fx, outliers.univariate_outliers, O.univariate_outliers)
    for fx in ("f4", "f5", "f6"):
        register(f"record_matching_{fx}", fx, paired.record_matching, O.record_matching, on_prepared=True)
        register(f"paired_stats_{fx}", fx, paired.paired_stats, O.paired_stats)
        register(f"paired_report_{fx}", fx, paired.paired_report)
        register(f"paired_summary_{fx}", fx, paired.paired_summary, O.paired_summary)
    register("paired_stats_f11", "f11", paired.paired_stats, O.paired_stats)
    register("paired_summary_f11", "f11", paired.paired_summary, O.paired_summary)
    register("paired_scatter_f11", "f11", paired.paired_scatter, O.paired_scatter)
    register("violin_curve_f8", "f8", lambda t: plotdata.kde_curve(t, cut=0.0).withColumn("Density", sig(F.col("Density"), 7)),
             O.violin_curve)  # seven digits: the tails of the kernel magnify the last ones of the variance
    for fx in ("f1", "f10"):
        register(f"pca_identities_{fx}", fx, multivariate.pca_identities, O.pca_identities)
    register("missingness_correlation_f11", "f11", profile.missingness_correlation, O.missingness_correlation, on_prepared=True)
    register("bland_altman_density_f5", "f5", paired.bland_altman_density, O.bland_altman_density)
    for fx in ("f2", "f3", "f1", "f7"):
        register(f"pearson_matrix_{fx}", fx, correlation.pearson_matrix, O.pearson_matrix)
        register(f"spearman_matrix_{fx}", fx, correlation.spearman_matrix, O.spearman_matrix)
    for fx in ("f2", "f3", "f7"):
        register(f"kendall_matrix_{fx}", fx, correlation.kendall_matrix, O.kendall_matrix)
    register("high_correlation_pairs_f7", "f7", correlation.high_correlation_pairs)
    register("high_correlation_pairs_f2", "f2", correlation.high_correlation_pairs, O.high_correlation_pairs)
    register("high_correlation_pairs_f10", "f10", lambda t: correlation.high_correlation_pairs(
        t, correlation.pearson_matrix(t).unionByName(correlation.spearman_matrix(t))),
        lambda fx: O.high_correlation_pairs(fx, (O.pearson_matrix, O.spearman_matrix)))
    for fx in ("f1", "f2", "f9"):
        register(f"redundancy_flags_{fx}", fx, redundancy.redundancy_flags, O.redundancy_flags)
    register("vif_f3", "f3", lambda t: redundancy.vif(t).select(
        ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"), F.col("vif").alias("VIF")), O.vif_two)
    for fx in ("f1", "f7", "f9", "f10"):
        register(f"redundancy_report_{fx}", fx, redundancy.redundancy_report, O.redundancy_report)
    for fx in ("f1", "f2", "f8", "f9"):
        register(f"quality_score_{fx}", fx, quality.quality_score, O.quality_score)
    for fx in ("f1", "f9"):
        register(f"conclusions_{fx}", fx, quality.conclusions, O.conclusions)
    register("conclusions_f4", "f4", quality.conclusions, O.conclusions_paired)
    register("mahalanobis_summary_f8", "f8", multivariate.mahalanobis_summary, O.mahalanobis_single)
    for fx in ("f3", "f7", "f8"):
        register(f"lof_scores_{fx}", fx, lof.lof_scores, O.lof_scores)
    for fx in ("f3", "f8"):
        register(f"lof_summary_{fx}", fx, lambda t: multivariate.multivariate_outliers(t, ("LOF",)), O.lof_summary)
    register("redundancy_report_f3", "f3", redundancy.redundancy_report, O.redundancy_report_two)
    for fx in ("f1", "f8"):
        register(f"histogram_table_{fx}", fx, compare.histogram_table, O.histogram_table)
    for fx in ("f1", "f2", "f8"):
        register(f"normality_tests_{fx}", fx, normality.normality_tests, O.normality_tests)
        register(f"normality_report_{fx}", fx, normality.normality_report)
    register("qq_points_f8", "f8", normality.qq_points)
    for fx in ("f7", "f1"):
        register(f"multivariate_outliers_{fx}", fx, multivariate.multivariate_outliers)
        register(f"pca_variance_{fx}", fx, multivariate.pca_variance)
        register(f"pca_loadings_{fx}", fx, multivariate.pca_loadings)
    register("pca_variance_f3", "f3", multivariate.pca_variance, O.pca_variance_two)
    register("outlier_projection_f7", "f7", multivariate.outlier_projection)
    register("batch_importance_f7", "f7", batch.batch_importance)
    register("batch_report_f7", "f7", batch.batch_report)
    register("combined_view_f7", "f7", batch.combined_view)
    register("combined_view_counts_f6", "f6", lambda t: batch.combined_view(t).groupBy("Dataset").agg(
        F.count("PC1").alias("Rows")), O.row_counts)
    register("multivariate_outliers_f9", "f9", multivariate.multivariate_outliers)
    register("pca_variance_f9", "f9", multivariate.pca_variance)
    register("batch_report_f9", "f9", batch.batch_report)
    for fx in ("f1", "f8"):
        register(f"density_histogram_{fx}", fx, plotdata.density_histogram, O.density_histogram)
        register(f"kde_curve_{fx}", fx, plotdata.kde_curve, O.kde_curve)
        register(f"box_summary_{fx}", fx, plotdata.box_summary, O.box_summary)
        register(f"ecdf_points_{fx}", fx, plotdata.ecdf_points, O.ecdf_points)
        register(f"two_sample_qq_{fx}", fx, plotdata.two_sample_qq, O.two_sample_qq)
    register("relationships_f1", "f1", lambda t: plotdata.relationships(
        t, (("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"))), O.relationships)
    from .sources import sink
    register("publication_quality_f1", "f1", lambda t: sink.publication(quality.quality_score(t)),
             O.publication_quality)
    register("publication_missingness_top20_f9", "f9",
             lambda t: sink.top_slice(sink.publication(profile.missingness(t.p)),
                                      [F.desc("Missing_Percent"), "Dataset", "Feature"], 20),
             O.publication_missingness_top20)
    register("plausibility_text_f1", "f1", lambda t: sink.to_text(distribution.plausibility(t)), O.plausibility_text)
    register("scaled_matrix_f2", "f2", lambda t: multivariate.scaled_matrix(t)[0].select(
        ds_name(t.spec).alias("Dataset"), "id", *t.p.features), O.scaled_matrix)
    for fx in ("f1", "f2", "f7", "f8", "f9"):
        register(f"comparison_stats_{fx}", fx, compare.comparison_stats, O.comparison_stats)
        register(f"similarity_stats_{fx}", fx, compare.similarity_stats, O.similarity_stats)
    register("ks_exact_f3", "f3", lambda t: compare.ks_test(t, "exact"), O.ks_exact)
    for fx in ("f1", "f8"):
        register(f"comparison_report_{fx}", fx, compare.comparison_report)
        register(f"similarity_report_{fx}", fx, compare.similarity_report)


_register_all()
