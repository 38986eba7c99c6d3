"""Loader (CSV NaN handling, key aliases, overlap) and sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from featurelens.sources import sink
from featurelens.sources.fixtures import FIXTURES
from featurelens.sources.loader import prepare, read_table
from featurelens.spec import RunSpec
from tests.conftest import SF_SMALL


def test_alias_rename_and_overlap(spark):
    d1, d2, spec = FIXTURES["f3"](spark, SF_SMALL)
    p = prepare(d1, d2, spec)
    assert p.id_col == "id"
    assert p.features == ["acctbal", "nationkey"]       # name is shared but not numeric
    assert "mktsegment" not in p.columns and "name" in p.columns


def test_csv_nan_becomes_null(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value").limit(50)
    nan_rows = ev.withColumn("value", F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value")))
    d = tempfile.mkdtemp(prefix="fl-csv-", dir="/tmp")
    path = os.path.join(d, "t.csv")
    nan_rows.coalesce(1).write.option("header", True).csv(path)
    schema = "event_id long, value double"
    raw = read_table(spark, path, fmt="csv", schema=spark.createDataFrame([], schema).schema)
    p = prepare(raw.withColumnRenamed("event_id", "id"), raw.withColumnRenamed("event_id", "id"), RunSpec())
    n_null = p.d1.where(F.col("value").isNull()).count()
    n_nan = p.d1.where(F.isnan("value")).count()
    assert n_nan == 0 and n_null == nan_rows.where(F.isnan("value")).count()


def test_sinks(spark):
    df = spark.createDataFrame([("a", [1, 2], 1.23456), ("b", [], 2.0005)], "k string, ids array<int>, v double")
    txt = {r["k"]: r["ids"] for r in sink.to_text(df).collect()}
    assert txt == {"a": "1, 2", "b": "None"}
    pub = {r["k"]: r["v"] for r in sink.publication(df).collect()}
    assert pub["a"] == pytest.approx(1.235)
    d = tempfile.mkdtemp(prefix="fl-sink-", dir="/tmp")
    sink.write_report(df, os.path.join(d, "rep"), "extraction_validation", fmt="csv")
    back = spark.read.option("header", True).csv(os.path.join(d, "rep"))
    assert back.where(F.col("mode") == "extraction_validation").count() == 2


def test_pipeline_light(spark):
    from featurelens.pipeline import run

    d1, d2, spec = FIXTURES["f6"](spark, SF_SMALL)
    r = run(d1, d2, spec, heavy=False)
    assert {"record_matching", "paired_validation", "feature_quality", "conclusions"} <= set(r)
    q = r["feature_quality"].collect()
    assert len(q) == 1 and q[0]["Feature"] == "n_chars"
