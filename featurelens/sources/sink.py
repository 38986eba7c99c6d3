"""Report sinks.

Reports stay DataFrames until written once.  Array-valued fields are joined
to text only here (", " separator, "None" when empty), publication tables
round every double column half-even to 3 decimals, and each run writes under
a ``mode`` partition so validation and comparison outputs never collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_text(df: DataFrame, sep: str = ", ", empty: str = "None") -> DataFrame:
    """Array columns -> joined strings (the CSV form of list-valued report fields)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            j = F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), sep)
            cols.append(F.when(F.size(f.name) > 0, j).otherwise(F.lit(empty)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def publication(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Every double column rounded half-even to ``decimals`` places."""
    return df.select(*[F.bround(F.col(f.name), decimals).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def top_slice(df: DataFrame, order: list, n: int = 20) -> DataFrame:
    """The first ``n`` rows of a publication table in report order (a top-k is the feature)."""
    return df.orderBy(*order).limit(n)


def write_report(df: DataFrame, path: str, mode_name: str, fmt: str = "parquet") -> None:
    """S6 + S8: overwrite one report under ``path``, partitioned by run mode."""
    out = df.withColumn("mode", F.lit(mode_name))
    if fmt == "csv":
        out = to_text(out)
        (out.write.mode("overwrite").option("header", True).partitionBy("mode").csv(path))
    else:
        out.write.mode("overwrite").partitionBy("mode").format(fmt).save(path)


def write_all(reports: dict, root: str, mode_name: str, fmt: str = "parquet") -> list:
    """Write every report of ``reports`` (name -> DataFrame) under ``root/name``; returns the paths."""
    paths = []
    for name, df in reports.items():
        p = f"{root.rstrip('/')}/{name}"
        write_report(df, p, mode_name, fmt)
        paths.append(p)
    return paths
