"""Scans and preparation of the two input tables.

``prepare`` turns two raw DataFrames into the pair every operator works on:
shared columns only, the key renamed from its aliases, feature columns cast
to double with NaN turned into NULL, exact duplicate rows removed.  All of it
is lazy column algebra; Parquet sees only the projected columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import RunSpec


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Read a feature table.

    CSV files are read with a header and, when given, an explicit schema so
    ``NA``/``nan``/empty become NULL; the NaN that survives as a double is
    removed later by ``clean_numeric``.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("nanValue", "NaN").option("nullValue", "")
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def rename_aliases(df: DataFrame, spec: RunSpec) -> DataFrame:
    """Rename the first alias present to ``spec.id_col`` if the key is absent."""
    if spec.id_col in df.columns:
        return df
    for alias in spec.id_aliases:
        if alias in df.columns:
            return df.withColumnRenamed(alias, spec.id_col)
    return df


def resolve_id(df: DataFrame, spec: RunSpec) -> str:
    """S3: key column: the configured name, an alias, else the first column."""
    if spec.id_col in df.columns:
        return spec.id_col
    for alias in spec.id_aliases:
        if alias in df.columns:
            return alias
    return df.columns[0]


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def numeric_features(d1: DataFrame, d2: DataFrame, id_col: str) -> list[str]:
    """S4+S5: sorted shared columns that are numeric in both inputs, key excluded."""
    t1 = dict((f.name, f.dataType) for f in d1.schema.fields)
    t2 = dict((f.name, f.dataType) for f in d2.schema.fields)
    shared = sorted(set(t1) & set(t2))
    return [c for c in shared if c != id_col and _is_numeric(t1[c]) and _is_numeric(t2[c])]


def clean_numeric(c: str, dt: T.DataType) -> Column:
    """NaN -> NULL for floating columns (Spark keeps NaN; pandas treats it as missing)."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    return F.col(c)


@dataclass
class Prepared:
    """The analysed pair.

    ``d1``/``d2``: deduplicated shared columns (features keep their numeric
    type, floats cleaned of NaN).  ``raw1``/``raw2``: the same projection before
    the exact-duplicate drop (record matching and duplicate counts read these).
    """

    d1: DataFrame
    d2: DataFrame
    raw1: DataFrame
    raw2: DataFrame
    features: list
    columns: list
    spec: RunSpec

    @property
    def id_col(self) -> str:
        return self.spec.id_col

    def named(self):
        return [(self.spec.dataset1_name, self.d1), (self.spec.dataset2_name, self.d2)]


def prepare(d1: DataFrame, d2: DataFrame, spec: RunSpec, dedup: bool = True) -> Prepared:
    d1 = rename_aliases(d1, spec)
    d2 = rename_aliases(d2, spec)
    id_col = spec.id_col if spec.id_col in d1.columns else resolve_id(d1, spec)
    if id_col != spec.id_col:
        spec = spec.with_(id_col=id_col)
    if id_col not in d2.columns:  # the second table's own key takes the first one's name
        d2 = d2.withColumnRenamed(resolve_id(d2, spec), id_col)
    shared = sorted(set(d1.columns) & set(d2.columns))
    cols = [id_col] + [c for c in shared if c != id_col]
    types1 = dict((f.name, f.dataType) for f in d1.schema.fields)
    types2 = dict((f.name, f.dataType) for f in d2.schema.fields)
    raw1 = d1.select(*[clean_numeric(c, types1[c]) for c in cols])
    raw2 = d2.select(*[clean_numeric(c, types2[c]) for c in cols])
    feats = numeric_features(raw1, raw2, id_col)
    # Exact duplicates (NULL == NULL, like pandas); an aggregate with map-side
    # partial combine, so a hot duplicate group never lands whole in one task.
    out1 = raw1.dropDuplicates() if dedup else raw1
    out2 = raw2.dropDuplicates() if dedup else raw2
    return Prepared(out1, out2, raw1, raw2, feats, cols, spec)
