"""Distribution statistics, plausibility bounds and extremes.

Moments come from one map-side aggregate over the long table; percentiles,
median and MAD are exact (``plans.rank``); bounds are joined back as a
features-sized broadcast table; top/bottom-N come from bounded heaps in
each task of one scan, merged per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rank import local
from ..plans.shape import unpivot
from ..plans.tables import PCTS, Tables, ds_name


def distribution_stats(t: Tables) -> DataFrame:
    """18 statistics per dataset and feature (population moments, numpy percentiles)."""
    m = t.moments
    p = t.percentiles
    out = m.join(p, ["ds", "feature"]).join(t.mad, ["ds", "feature"], "left")
    return out.select(
        ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"),
        F.col("mean").alias("Mean"), F.col("p50").alias("Median"), F.col("sd_pop").alias("SD"),
        F.col("min").alias("Min"), F.col("max").alias("Max"),
        (F.col("p75") - F.col("p25")).alias("IQR"), F.col("mad").alias("MAD"),
        F.col("var_pop").alias("Variance"), F.col("skew").alias("Skewness"), F.col("kurt").alias("Kurtosis"),
        *[F.col(k) for k in PCTS])


def bounds(t: Tables) -> DataFrame:
    """(feature, lower, upper) = configured percentiles of the reference dataset."""
    th = t.spec.thresholds
    ref_ds = 1 if t.spec.is_paired else 2
    lo, hi = th.plausibility_lower_pct / 100.0, th.plausibility_upper_pct / 100.0
    q = t.quantiles(sorted({lo, hi}))
    q = q.where(F.col("ds") == ref_ds)
    return q.groupBy("feature").agg(
        F.max(F.when(F.abs(F.col("q") - lo) < 1e-12, F.col("quantile"))).alias("lower"),
        F.max(F.when(F.abs(F.col("q") - hi) < 1e-12, F.col("quantile"))).alias("upper"))


def plausibility(t: Tables) -> DataFrame:
    """Values of the target dataset strictly outside the reference bounds.

    ``Extreme_ECG_ID_Examples`` lists the ``example_ids`` smallest keys among
    the violating rows (Spark has no row order; the key is the tie-break) as an
    array; ``sinks.to_text`` joins it with ", " (empty -> "None").
    """
    spec = t.spec
    tgt = t.p.d2 if spec.is_paired else t.p.d1
    b = local(bounds(t))
    ref = spec.reference_name
    out_flag = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    # a value's rows are judged together; only rows that stray somewhere are unpivoted for their keys
    counts = (t.counts.where(F.col("ds") == (2 if spec.is_paired else 1)).join(F.broadcast(b), "feature")
              .groupBy("feature").agg(F.sum(F.when(out_flag, F.col("n")).otherwise(0)).alias("n_out"), F.sum("n").alias("n_valid")))
    strays = [(F.col(r["feature"]).cast("double") < r["lower"]) | (F.col(r["feature"]).cast("double") > r["upper"]) for r in b.collect()]
    lv = unpivot(tgt.where(reduce(or_, strays, F.lit(False))), t.p.id_col, t.p.features).join(F.broadcast(b), "feature")
    w = Window.partitionBy("feature").orderBy(F.col("id").asc_nulls_last())
    ex = (lv.where(out_flag & F.col("id").isNotNull())
          .select("feature", "id")
          .withColumn("_rn", F.row_number().over(w))
          .where(F.col("_rn") <= spec.example_ids)
          .groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("_rn", "id"))).alias("_ex")))
    r = b.join(counts, "feature", "left").join(ex, "feature", "left")
    n_out = F.coalesce(F.col("n_out"), F.lit(0))
    pct = F.when(F.col("n_valid") > 0, F.bround(n_out / F.col("n_valid") * 100, 2)).otherwise(F.lit(0.0))
    return r.select(
        F.col("feature").alias("Feature"),
        F.col("lower").alias(f"Lower_Bound_{ref}"), F.col("upper").alias(f"Upper_Bound_{ref}"),
        n_out.alias("Num_Outside_Range"), pct.alias("Pct_Outside_Range"),
        F.coalesce(F.transform("_ex", lambda s: s["id"].cast("string")),
                   F.array().cast("array<string>")).alias("Extreme_ECG_ID_Examples"),
        F.lit(f"Bounds from {ref}").alias("Note"))


def _ends(df: DataFrame, ds: int, id_col: str, features: list, id_type: T.DataType, n: int) -> DataFrame:
    """The first ``n`` rows of each end of each feature in every Arrow batch and then in every task: (ds, feature, top, value, id)."""
    wide = df.select(F.col(id_col).cast(id_type).alias("id"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)])
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("top", T.BooleanType()),
                           T.StructField("value", T.DoubleType()), T.StructField("id", id_type)])

    def first(rows: pa.Table, top: bool) -> pa.Table:
        order = [("value", "descending" if top else "ascending"), ("id", "ascending")]
        return rows.take(pc.select_k_unstable(rows, n, sort_keys=order))  # a bounded heap; rows equal in both keys are the same row

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(len(features)):
                values = batch.column(f"v{i}")
                rows = pa.table({"value": values, "id": batch.column("id")}).filter(values.is_valid())
                for top in (True, False):
                    if rows.num_rows:
                        best = first(rows, top)
                        held[i, top] = first(pa.concat_tables([held[i, top], best]), top) if (i, top) in held else best
        for (i, top), rows in held.items():
            count = rows.num_rows
            yield from pa.table({"feature": pa.array([features[i]] * count), "top": pa.array([top] * count), "value": rows["value"],
                                 "id": rows["id"]}).combine_chunks().to_batches()

    return wide.mapInArrow(ends, schema).withColumn("ds", F.lit(ds))


def extremes(t: Tables) -> DataFrame:
    """Top-N and bottom-N values per dataset and feature, with their keys.

    Ties keep the smaller key first, null keys last.  Values are rounded half-even to 4 dp;
    both lists are arrays in rank order.  One scan of each wide table keeps bounded heaps for
    both ends of all features; at most N rows of an end leave a task, and a window merges them.
    """
    n, p = t.spec.extremes_n, t.p
    id_type = t.long.schema["id"].dataType
    both = _ends(p.d1, 1, p.id_col, p.features, id_type, n).unionByName(_ends(p.d2, 2, p.id_col, p.features, id_type, n))
    w = Window.partitionBy("ds", "feature", "top").orderBy(
        F.when(F.col("top"), -F.col("value")).otherwise(F.col("value")), F.col("id").asc_nulls_last())
    r = (both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
         .groupBy("ds", "feature", "top").agg(F.array_sort(F.collect_list(F.struct("_rn", "value", "id"))).alias("_l")))
    return r.select(
        ds_name(t.spec).alias("Dataset"), F.col("feature").alias("Feature"),
        F.when(F.col("top"), f"Top {n}").otherwise(f"Bottom {n}").alias("Extreme_Type"),
        F.transform("_l", lambda s: F.bround(s["value"], 4)).alias("Values"),
        F.transform("_l", lambda s: s["id"]).alias("ECG_IDs"))
