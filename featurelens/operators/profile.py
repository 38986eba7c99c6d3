"""Profiles: missingness, constancy flags, overview and feature summary.

Everything here is a one-pass aggregate over the wide table (one column of
partial aggregates per input column) and an unpivot of its single-row
result, so no row ever shuffles.  Near-constancy needs the modal value: a
value holding at least 99% of the rows occupies every rank from 1% to 99%,
so it *is* the (approximate) median; ``percentile_approx`` (bounded sketch)
yields the candidate and a second pass counts it exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import Tables
from ..sources.loader import Prepared


def _key(c: str, dt: T.DataType):
    """Comparable numeric key of a column: the value, or a 64-bit hash for non-numerics."""
    if isinstance(dt, T.NumericType):
        return F.col(c).cast("double")
    return F.xxhash64(F.col(c)).cast("double")


def column_profile(df: DataFrame, cols: list, share: float = 0.99) -> DataFrame:
    """(Feature, rows, missing, distinct_ge2, modal_share) for every column of ``df``.

    ``distinct_ge2``: at least two distinct non-null values (min != max).
    ``modal_share``: share of the most frequent non-null value when it reaches
    ``share`` (else a value below ``share``), exact.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    first = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        k = _key(c, types[c])
        first += [F.count(F.col(c)).alias(f"n{i}"),
                  (F.min(k) != F.max(k)).alias(f"v{i}"),
                  F.percentile_approx(k, 0.5, 10000).alias(f"m{i}")]
    a = df.agg(*first)
    # second pass: exact count of the candidate mode of each column
    # the single-row candidate table is attached by an equi-join on a constant key
    # (a one-row broadcast), so both passes stay map-side aggregates
    cand = a.select(F.lit(0).alias("_k"), *[F.col(f"m{i}") for i in range(len(cols))])
    counts = df.withColumn("_k", F.lit(0)).join(F.broadcast(cand), "_k").agg(
        F.lit(0).alias("_k"),
        *[F.count_if(_key(c, types[c]) == F.col(f"m{i}")).alias(f"k{i}") for i, c in enumerate(cols)])
    both = a.withColumn("_k", F.lit(0)).join(F.broadcast(counts), "_k")
    rows = [F.struct(F.lit(c).alias("Feature"), F.col("_rows").alias("rows"),
                     (F.col("_rows") - F.col(f"n{i}")).alias("missing"),
                     F.coalesce(F.col(f"v{i}"), F.lit(False)).alias("distinct_ge2"),
                     F.when(F.col(f"n{i}") > 0, F.col(f"k{i}") / F.col(f"n{i}")).alias("modal_share"))
            for i, c in enumerate(cols)]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missingness(p: Prepared) -> DataFrame:
    """A2: Dataset, Feature, Missing_Count, Missing_Percent over all kept columns incl. the key."""
    parts = []
    for name, df in p.named():
        aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"n{i}")
                                                       for i, c in enumerate(p.columns)]
        a = df.agg(*aggs)
        rows = [F.struct(F.lit(c).alias("Feature"), F.col(f"n{i}").alias("Missing_Count"),
                         F.when(F.col("_rows") > 0, F.col(f"n{i}") / F.col("_rows") * 100).alias("Missing_Percent"))
                for i, c in enumerate(p.columns)]
        parts.append(a.select(F.lit(name).alias("Dataset"), F.explode(F.array(*rows)).alias("r"))
                     .select("Dataset", "r.*"))
    return reduce(DataFrame.unionByName, parts)


def _pandas_dtype(dt: T.DataType, has_null: bool) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "float64" if has_null else "int64"
    if isinstance(dt, T.NumericType):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "object"


def _flags(prof: DataFrame, share: float) -> DataFrame:
    const = ~F.col("distinct_ge2")
    near = (~const) & (F.col("modal_share") >= share)
    return prof.withColumn("Is_Constant", const).withColumn("Is_Near_Constant", near) \
               .withColumn("Is_All_Missing", F.col("missing") == F.col("rows"))


def feature_summary(p: Prepared) -> DataFrame:
    """Dataset, Feature, DataType, Missing_Count, Missing_Percent, three flags."""
    share = p.spec.thresholds.near_constant_share
    parts = []
    for name, df in p.named():
        prof = _flags(column_profile(df, p.columns, share), share)
        types = dict((f.name, f.dataType) for f in df.schema.fields)
        dtype = F.lit("object")
        for c in p.columns:
            dtype = F.when(F.col("Feature") == c,
                           F.when(F.col("missing") > 0, _pandas_dtype(types[c], True))
                           .otherwise(_pandas_dtype(types[c], False))).otherwise(dtype)
        parts.append(prof.select(F.lit(name).alias("Dataset"), "Feature", dtype.alias("DataType"),
                                 F.col("missing").alias("Missing_Count"),
                                 F.when(F.col("rows") > 0, F.col("missing") / F.col("rows") * 100)
                                 .alias("Missing_Percent"),
                                 "Is_Constant", "Is_Near_Constant", "Is_All_Missing"))
    return reduce(DataFrame.unionByName, parts)


def _volume_mb(df: DataFrame) -> F.Column:
    """A9 (re-aimed): data volume in MB — 8 bytes per numeric cell, UTF-8 bytes of strings."""
    terms = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, T.BooleanType):
            terms.append(F.lit(8))
        else:
            terms.append(F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)))
    return F.sum(reduce(lambda a, b: a + b, terms)) / (1024.0 * 1024.0)


def overview(p: Prepared) -> DataFrame:
    """One row per dataset (9 fields).

    ``Duplicate_Rows`` counts the exact duplicates removed at load (the
    analysed tables are duplicate-free); ``Duplicate_IDs`` = rows - distinct
    keys - (1 if any key is NULL), pandas ``duplicated`` semantics.
    """
    share = p.spec.thresholds.near_constant_share
    parts = []
    for (name, df), raw in zip(p.named(), (p.raw1, p.raw2)):
        prof = _flags(column_profile(df, p.columns, share), share)
        flags = prof.agg(F.count_if("Is_Constant").alias("Constant_Columns"),
                         F.count_if("Is_Near_Constant").alias("Near_Constant_Columns"),
                         F.count_if("Is_All_Missing").alias("All_Missing_Columns"))
        idc = F.col(p.id_col)
        base = df.agg(F.count(F.lit(1)).alias("Total_ECGs"),
                      F.round(_volume_mb(df), 2).alias("Memory_Usage_MB"),
                      (F.count(F.lit(1)) - F.count_distinct(idc)
                       - F.max(F.when(idc.isNull(), 1).otherwise(0))).alias("Duplicate_IDs"))
        dup = raw.agg(F.count(F.lit(1)).alias("_raw"))
        one = F.lit(0).alias("_k")
        parts.append(base.select(one, "*").join(F.broadcast(dup.select(one, "*")), "_k")
                     .join(F.broadcast(flags.select(one, "*")), "_k").select(
            F.lit(name).alias("Dataset"), "Total_ECGs", F.lit(len(df.columns)).alias("Total_Features"),
            "Memory_Usage_MB", F.col("Duplicate_IDs").cast("long").alias("Duplicate_IDs"),
            (F.col("_raw") - F.col("Total_ECGs")).alias("Duplicate_Rows"),
            "Constant_Columns", "Near_Constant_Columns", "All_Missing_Columns"))
    return reduce(DataFrame.unionByName, parts)


def null_pairs(df: DataFrame, cols: list) -> DataFrame:
    """(i, j, n) for i <= j: rows in which columns i and j are both null.

    Each Arrow batch packs a column's nulls into a bitmap and counts common bits of each pair; a task sends p^2 sums.
    """
    p = len(cols)
    i, j = np.triu_indices(p)

    def counted(batches):
        total = np.zeros((p, p), np.int64)
        for batch in batches:
            bits = np.packbits(np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns]), axis=1)
            for k in range(p):
                total[k] += np.bitwise_count(bits & bits[k]).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                         names=["i", "j", "n"])

    return df.select(*cols).mapInArrow(counted, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def missingness_correlation(p: Prepared) -> DataFrame:
    """A10: Pearson r of the null indicators of columns that have nulls, per dataset.

    (Dataset, Feature_1, Feature_2, Correlation), upper triangle; a column with nulls only, or none, has no correlation.
    """
    parts, names = [], F.array(*[F.lit(c) for c in p.columns])
    for name, df in p.named():
        both = null_pairs(df, p.columns)
        one = both.where("i = j").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).cast("double").alias("rows"))))
        a, b = one.select("i", F.col("n").alias("na"), "rows"), one.select("j", F.col("n").alias("nb"))
        n, x, y, k = F.col("rows"), F.col("na"), F.col("nb"), F.col("n")
        r = (n * k - x * y) / (F.sqrt(x * (n - x)) * F.sqrt(y * (n - y)))
        parts.append(both.where("i < j").join(F.broadcast(a), "i").join(F.broadcast(b), "j")
                     .where((x > 0) & (x < n) & (y > 0) & (y < n))
                     .select(F.lit(name).alias("Dataset"), F.element_at(names, F.col("i") + 1).alias("Feature_1"),
                             F.element_at(names, F.col("j") + 1).alias("Feature_2"), r.alias("Correlation")))
    return reduce(DataFrame.unionByName, parts)


def missingness_patterns(p: Prepared) -> DataFrame:
    """Null pattern per row ('1' = missing, columns in name order) with counts."""
    parts = []
    for name, df in p.named():
        pat = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in p.columns])
        parts.append(df.groupBy(pat.alias("Pattern")).count().select(
            F.lit(name).alias("Dataset"), "Pattern", F.col("count").alias("Rows")))
    return reduce(DataFrame.unionByName, parts)
