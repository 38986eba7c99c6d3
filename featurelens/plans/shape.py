"""Shared derived tables: long form ``L``, value counts ``VC``, ranks ``RK``,
histogram ``H`` and the paired long form ``PL``.

Every per-feature report is a group-by over one of these, so all features are
processed at once by one plan instead of a driver loop over columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.loader import Prepared
from .rank import local


def unpivot(df: DataFrame, id_col: str, features: list, ds: int | None = None) -> DataFrame:
    """Wide -> long ``(id, feature, value)`` with non-null values only.

    The key column is renamed ``id`` whatever its input name.
    """
    cols = [F.col(id_col).alias("id")] + [F.col(f).cast("double").alias(f) for f in features]
    out = df.select(*cols).unpivot(["id"], features, "feature", "value").where(F.col("value").isNotNull())
    if ds is not None:
        out = out.withColumn("ds", F.lit(ds))
    return out


def long_table(p: Prepared) -> DataFrame:
    """``L``: (ds, id, feature, value) for both datasets; ds is 1 or 2."""
    return unpivot(p.d1, p.id_col, p.features, 1).unionByName(unpivot(p.d2, p.id_col, p.features, 2))


def wide_table(p: Prepared) -> DataFrame:
    """(ds, features as doubles), a row per row of either dataset."""
    sides = [df.select(F.lit(d).alias("ds"), *[F.col(f).cast("double").alias(f) for f in p.features]) for d, df in ((1, p.d1), (2, p.d2))]
    return sides[0].unionByName(sides[1])


def present(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[int, list, list]]:
    """Of each Arrow batch of ``wide_table`` and each dataset in it: the dataset, its columns and where they have a value."""
    for batch in batches:
        ds = batch.column(0).to_numpy()
        x = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(p)]
        for d in np.unique(ds).tolist():
            mine = x if ds[0] == d and (ds == d).all() else [c[ds == d] for c in x]
            yield d, mine, [~np.isnan(c) for c in mine]


def value_counts(long: DataFrame) -> DataFrame:
    """``VC``: (feature, value, n1, n2). Shuffles distinct values, not rows."""
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("ds") == 1).alias("n1"),
        F.count_if(F.col("ds") == 2).alias("n2"))


def class_counts(wide: DataFrame, features: list, classes: list) -> DataFrame:
    """(ds, feature, value, w0, w1, ...): rows of each value; w<b> counts those where column ``classes[b][0]`` has a value too (one class: all).

    Values are counted in each Arrow batch first, so only a batch's distinct values are grouped and shuffled.
    """
    k = len(classes)
    names = ["ds", "f", "value", *[f"w{b}" for b in range(k)]]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, there in present(batches, len(features)):
            found = []
            for i, column in enumerate(x):
                if k == 1:
                    values, n = np.unique(column[there[i]], return_counts=True)
                    weights = [n]
                else:
                    values, at = np.unique(column[there[i]], return_inverse=True)
                    weights = [np.bincount(at[there[c[0]][there[i]]], minlength=len(values)) for c in classes]
                found.append([np.full(len(values), d, np.int32), np.full(len(values), i, np.int32), values, *[w.astype(np.int64) for w in weights]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    parts = wide.mapInArrow(counted, "ds int, f int, value double, " + ", ".join(f"w{b} long" for b in range(k)))
    sums = parts.groupBy("ds", "f", "value").agg(*[F.sum(w).alias(w) for w in names[3:]])
    feature = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    return sums.select("ds", feature.alias("feature"), "value", *names[3:])


def moments(p: Prepared, together: int = 4, few: int = 16) -> DataFrame:
    """(ds, feature, n, mean, var_pop, var_samp, sd_pop, min, max, skew, kurt) of the features that have a value.

    Aggregates without a key over the wide tables: no long form, no hashing of features.  ``together`` columns are in one aggregate: with more
    sums than ``spark.sql.codegen.maxFields`` (100) it would not be compiled.
    More than ``few`` columns are grouped in long form: each aggregate costs its planning and compiling.
    """
    stats = {"n": F.count, "mean": F.avg, "var_pop": F.var_pop, "min": F.min, "max": F.max, "skew": F.skewness, "kurt": F.kurtosis}
    n, var = F.col("n"), F.col("var_pop")
    parts = []
    if len(p.features) > few:
        parts = [long_table(p).groupBy("ds", "feature").agg(*[of(F.col("value")).alias(k) for k, of in stats.items()])]
    for d, df in ((1, p.d1), (2, p.d2)) if not parts else ():
        for at in range(0, len(p.features), together):
            some = p.features[at:at + together]
            one = df.select(*[F.col(f).cast("double").alias(f) for f in some]).agg(
                *[of(F.col(f)).alias(f"{k}{i}") for i, f in enumerate(some) for k, of in stats.items()])
            rows = [F.struct(F.lit(d).alias("ds"), F.lit(f).alias("feature"), *[F.col(f"{k}{i}").alias(k) for k in stats])
                    for i, f in enumerate(some)]
            parts.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    if not parts:
        parts = [p.d1.sparkSession.createDataFrame([], "ds int, feature string, n long, " + ", ".join(f"{k} double" for k in list(stats)[1:]))]
    return reduce(DataFrame.unionByName, parts).where(n > 0).select(
        "ds", "feature", "n", "mean", "var_pop", F.when(n > 1, var * F.try_divide(n, n - 1)).alias("var_samp"), F.sqrt(var).alias("sd_pop"),
        "min", "max", "skew", "kurt")


def numpy_bin(v, lo, hi, bins: int):
    """0-based bin of ``v`` in ``bins`` equal bins over [lo, hi], the last bin closed.

    Reproduces numpy's histogram exactly: a first guess from the scaled offset,
    then corrected against the edges ``i*step + lo`` (numpy's ``linspace``).
    """
    step = (hi - lo) / bins
    guess = F.floor((v - lo) / (hi - lo) * bins).cast("int")
    guess = F.when(guess >= bins, bins - 1).otherwise(guess)
    lower = guess * step + lo
    upper = (guess + 1) * step + lo
    return (F.when(v < lower, guess - 1)
            .when((guess != bins - 1) & (v >= upper), guess + 1)
            .otherwise(guess))


def histogram(vc: DataFrame, bins: int) -> DataFrame:
    """``H``: dense (feature, bin, c1, c2, width, step, n1, n2, lo, hi) on the pooled range.

    Only features with lo < hi and values in both datasets are binned (the
    reports short-cut the other cases).  The dense grid comes from exploding
    ``sequence(0, bins-1)`` per feature: a features x bins table.
    """
    rng = vc.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum("n1").alias("N1"), F.sum("n2").alias("N2"))
    # a row per feature, kept as constants: joined to itself, a kept ``vc`` would be computed anew
    rng = local(rng.where((F.col("lo") < F.col("hi")) & (F.col("N1") > 0) & (F.col("N2") > 0)))
    b = (vc.join(F.broadcast(rng.select("feature", "lo", "hi")), "feature")
         .withColumn("bin", numpy_bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
         .groupBy("feature", "bin").agg(F.sum("n1").alias("c1"), F.sum("n2").alias("c2")))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / bins
    left = F.col("bin") * step + F.col("lo")
    right = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise((F.col("bin") + 1) * step + F.col("lo"))
    return (grid.join(b, ["feature", "bin"], "left")
            .select("feature", "bin", F.coalesce("c1", F.lit(0)).alias("c1"),
                    F.coalesce("c2", F.lit(0)).alias("c2"),
                    (right - left).alias("width"), step.alias("step"),
                    "N1", "N2", "lo", "hi"))


def paired_long(p: Prepared) -> DataFrame:
    """``PL``: (id, feature, v1, v2) for matched keys, both values non-null.

    Keep-first per key is deterministic: the row with the smallest feature
    tuple (features in name order, NULL first) wins.  ``min(struct)`` is an
    aggregate with map-side partial combine, so a key repeated in a third of
    the rows is never gathered into one task.
    """
    def first_per_key(df: DataFrame, side: str) -> DataFrame:
        feats = [F.col(f).cast("double").alias(f) for f in p.features]
        one = (df.where(F.col(p.id_col).isNotNull()).select(F.col(p.id_col), *feats)
               .groupBy(p.id_col).agg(F.min(F.struct(*p.features)).alias("_r")))
        return one.select(p.id_col, *[F.col(f"_r.{f}").alias(f"{f}__{side}") for f in p.features])

    k1, k2 = first_per_key(p.raw1, "1"), first_per_key(p.raw2, "2")
    j = k1.join(k2, p.id_col, "inner")
    pairs = ", ".join(f"'{f}', `{f}__1`, `{f}__2`" for f in p.features)
    out = j.selectExpr(f"`{p.id_col}` AS id", f"stack({len(p.features)}, {pairs}) AS (feature, v1, v2)")
    return out.where(F.col("v1").isNotNull() & F.col("v2").isNotNull())
