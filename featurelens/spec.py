"""Run parameters: a frozen description of one two-table analysis.

Nothing here touches Spark; every operator takes a ``RunSpec`` argument so a
job is fully described by its inputs and this object.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

VALIDATION = "extraction_validation"
COMPARISON = "cross_dataset_comparison"


@dataclass(frozen=True)
class Thresholds:
    # Fixed default values (they must equal the reference defaults for equal results).
    missingness_pct_warn: float = 5.0
    missingness_pct_critical: float = 10.0
    vif_high: float = 10.0
    outlier_iqr: float = 1.5
    outlier_z: float = 3.0
    outlier_mad: float = 3.5
    outlier_contamination: float = 0.01
    similarity_score_poor: float = 60.0
    similarity_score_fair: float = 70.0
    similarity_score_good: float = 80.0
    similarity_score_excellent: float = 90.0
    correlation_high: tuple = (0.90, 0.95, 0.99)
    normality_alpha: float = 0.05
    normality_skew_threshold: float = 2.0
    normality_kurtosis_threshold: float = 7.0
    plausibility_lower_pct: float = 1.0
    plausibility_upper_pct: float = 99.0
    mahalanobis_alpha: float = 0.001
    histogram_bins: int = 100
    # fixed rule constants used by the reports
    near_constant_share: float = 0.99
    near_constant_variance: float = 1e-4
    outlier_pct_warn: float = 5.0
    implausible_pct_warn: float = 1.0
    plausibility_pct_high: float = 5.0
    min_compare_n: int = 10
    min_normality_n: int = 20
    min_multivariate_rows: int = 50
    min_pca_rows: int = 10


@dataclass(frozen=True)
class RunSpec:
    """What to compare and how.

    ``id_col``: record key present in both tables (after alias renaming).
    ``id_aliases``: other names the key may carry in an input; renamed to
    ``id_col`` when ``id_col`` itself is absent.
    ``mode``: ``extraction_validation`` (paired; bounds from D1, target D2) or
    ``cross_dataset_comparison`` (unpaired; bounds from D2, target D1).
    ``rank_buckets``: number of value ranges of a group in the rank kernel (``plans.rank``);
    None leaves it to ``spark.sql.shuffle.partitions``.
    ``normality_rule``: "formal" (all three tests) or "practical" (skewness and
    kurtosis) decides ``Approx_Gaussian``; both verdicts are reported besides.
    ``wilcoxon_method``: "normal" or "exact".
    ``ks_method``: "one_sample" (Kolmogorov's finite law at n1 n2 / (n1 + n2)) or "exact" (the law of
    two untied samples; its work is about 2 KS n1 n2 a feature).
    """

    id_col: str = "id"
    dataset1_name: str = "D1"
    dataset2_name: str = "D2"
    mode: str = VALIDATION
    id_aliases: tuple = ()
    thresholds: Thresholds = field(default_factory=Thresholds)
    extremes_n: int = 20
    example_ids: int = 5
    normality_rule: str = "practical"
    wilcoxon_method: str = "normal"
    ks_method: str = "one_sample"
    seed: int = 42
    rank_buckets: int | None = None
    relationship_pairs: tuple = ()

    @property
    def is_paired(self) -> bool:
        return self.mode == VALIDATION

    @property
    def reference_name(self) -> str:
        """Dataset whose percentiles define plausibility bounds."""
        return self.dataset1_name if self.is_paired else self.dataset2_name

    @property
    def target_name(self) -> str:
        """Dataset checked against the bounds."""
        return self.dataset2_name if self.is_paired else self.dataset1_name

    def with_(self, **kw) -> "RunSpec":
        return replace(self, **kw)
