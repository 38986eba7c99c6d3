"""Lazily built, persisted shared tables for one prepared pair.

Reports are built as plans over these; the expensive ones (value counts and
ranks) are persisted so the reports that share them run them once.  Tables of a few rows per feature (moments, quantiles, MAD) are
computed when first asked for and kept as constants, which keeps the plans of reports short.  Lost
cached blocks are rebuilt from lineage; ranges are a function of the data, so a
rebuild gives the same result.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.loader import Prepared
from ..spec import RunSpec
from . import shape
from .rank import cumulate, group_quantiles, local, ranged

PCTS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
# numpy.linspace(0.01, 0.99, 100): probabilities of the quantile-correlation grid
QGRID = [float(x) for x in np.linspace(0.01, 0.99, 100)]


def ds_name(spec: RunSpec, ds_col: str = "ds"):
    return F.when(F.col(ds_col) == 1, F.lit(spec.dataset1_name)).otherwise(F.lit(spec.dataset2_name))


class Tables:
    def __init__(self, p: Prepared, persist: bool = True):
        self.spec: RunSpec = p.spec
        self._persist = persist
        self._held: list = []
        self._grids: dict = {}
        self._reports: dict = {}
        self._scales: dict = {}
        self._vectors: DataFrame | None = None
        # the deduplicated inputs feed every report: read and deduplicate once
        if persist:
            p.d1, p.d2 = self._keep(p.d1), self._keep(p.d2)
        self.p = p

    def _keep(self, df: DataFrame) -> DataFrame:
        if self._persist:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(df)
        return df

    def hold(self, df: DataFrame) -> DataFrame:
        """Persist always: for tables whose readers must see one and the same computation."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(df)
        return df

    def report(self, name: str, build) -> DataFrame:
        """The finished report ``name`` (a few rows per feature): built when first asked for, then shared by the reports that read it."""
        if name not in self._reports:
            self._reports[name] = local(build())
        return self._reports[name]

    def release(self):
        """Frees what the run holds; finished reports stay readable, others are computed anew if read again."""
        for df in self._held:
            df.unpersist()
        self._held.clear()

    @cached_property
    def rows(self) -> dict:
        """{ds: rows}."""
        return {1: self.p.d1.count(), 2: self.p.d2.count()}

    @cached_property
    def long(self) -> DataFrame:
        return shape.long_table(self.p)

    @cached_property
    def vc(self) -> DataFrame:
        return self._keep(shape.value_counts(self.long))

    @property
    def counts(self) -> DataFrame:
        """(ds, feature, value, n): the value counts of each dataset."""
        sides = F.explode(F.array(*[F.struct(F.lit(d).alias("ds"), F.col(f"n{d}").alias("n")) for d in (1, 2)])).alias("_x")
        return self.vc.select("feature", "value", sides).select("_x.ds", "feature", "value", "_x.n").where(F.col("n") > 0)

    @cached_property
    def ranged(self) -> DataFrame:
        """Value counts with their ranges (``plans.rank``)."""
        return ranged(self.vc, ["feature"], "value", self.spec.rank_buckets)

    @cached_property
    def rk(self) -> DataFrame:
        return self._keep(cumulate(self.ranged, ["feature"], "value", ["n1", "n2"]))

    @cached_property
    def ks_mw(self) -> DataFrame:
        """(feature, ks, r1, tie): T3 KS statistic, T5 rank sum of the first dataset (average ranks) and the tie term sum(t^3-t)."""
        n = F.col("n1") + F.col("n2")
        avg_rank = F.col("cum_n1") + F.col("cum_n2") - n + (n + 1) / 2.0
        return local(self.rk.groupBy("feature").agg(
            F.max(F.abs(F.col("cum_n1") / F.col("tot_n1") - F.col("cum_n2") / F.col("tot_n2"))).alias("ks"),
            F.sum(F.col("n1") * avg_rank).alias("r1"),
            F.sum(n.cast("double") * n * n - n).alias("tie")))

    @cached_property
    def hist(self) -> DataFrame:
        return local(shape.histogram(self.vc, self.spec.thresholds.histogram_bins))

    @cached_property
    def moments(self) -> DataFrame:
        """(ds, feature, n, mean, var_pop, var_samp, sd_pop, min, max, skew, kurt)."""
        return local(shape.moments(self.p))

    @cached_property
    def matrix_features(self) -> list:
        """Features with a value in both datasets.  A column that is all null in one has no median to impute and
        no place in a matrix; the matrix operators leave it out (``dropped_features``)."""
        found = self.moments.where("n > 0").groupBy("feature").count().where("count = 2").select("feature").collect()
        present = {r["feature"] for r in found}
        return [f for f in self.p.features if f in present]

    @property
    def dropped_features(self) -> list:
        return [f for f in self.p.features if f not in set(self.matrix_features)]

    @cached_property
    def standard_probs(self) -> list:
        """The probabilities most reports use — the seven percentiles and the
        plausibility bounds — computed together in one pass (the 100-point grid
        of the similarity report is a separate pass: it is needed only there)."""
        th = self.spec.thresholds
        extra = [th.plausibility_lower_pct / 100.0, th.plausibility_upper_pct / 100.0]
        return sorted(set(list(PCTS.values()) + extra))

    def _raw_quantiles(self, probs: list, rk: DataFrame | None = None) -> DataFrame:
        q = group_quantiles(self.ranged, ["feature"], "value", ["n1", "n2"], probs, rk=rk)
        return q.select("feature", (F.col("w") + 1).alias("ds"), "q", "quantile")

    @cached_property
    def quantile_table(self) -> DataFrame:
        """(ds, feature, q, quantile) for ``standard_probs`` — shared by all reports."""
        return local(self._raw_quantiles(self.standard_probs))

    def quantiles(self, probs: list) -> DataFrame:
        """(ds, feature, q, quantile) exact, for both datasets.

        Probabilities among ``standard_probs`` are read from the shared table;
        others, which are many, are computed from the shared rank table.
        """
        std = self.standard_probs
        if all(any(abs(q - s) < 1e-12 for s in std) for q in probs):
            want = F.array(*[F.lit(float(q)) for q in probs])
            qt = self.quantile_table
            return qt.where(F.exists(want, lambda w: F.abs(w - F.col("q")) < 1e-12))
        key = tuple(probs)
        if key not in self._grids:
            self._grids[key] = local(self._raw_quantiles(probs, self.rk))
        return self._grids[key]

    @cached_property
    def percentiles(self) -> DataFrame:
        """(ds, feature, p01..p99) — the seven report percentiles, exact."""
        q = self.quantiles(sorted(set(PCTS.values())))
        aggs = [F.max(F.when(F.abs(F.col("q") - x) < 1e-12, F.col("quantile"))).alias(k) for k, x in PCTS.items()]
        return local(q.groupBy("ds", "feature").agg(*aggs))

    @cached_property
    def mad(self) -> DataFrame:
        """(ds, feature, mad), the unscaled median absolute deviation, exact: of the value counts' deviations from the median."""
        med = self.percentiles.select("ds", "feature", F.col("p50").alias("_med"))
        dev = self.counts.join(F.broadcast(med), ["ds", "feature"]).select(
            "ds", "feature", F.abs(F.col("value") - F.col("_med")).alias("dev"), "n")
        q = group_quantiles(dev, ["ds", "feature"], "dev", ["n"], [0.5], self.spec.rank_buckets)
        return local(q.select("ds", "feature", F.col("quantile").alias("mad")))

    @cached_property
    def paired(self) -> DataFrame:
        return self._keep(shape.paired_long(self.p))
