"""Feature-table pairs derived from the test tables (F1-F9 of FIXTURES.md; F10: collinear columns; F11: paired, with nulls).

Each fixture returns ``(d1, d2, spec)`` — two wide tables and the run
parameters — built with DataFrame operations over the parquet tables, so the
work of every query grows with the tables.  ``FIXTURE_SQL`` holds the same
definitions for DuckDB (used by the SQL oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import COMPARISON, VALIDATION, RunSpec


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EMB_DIM = 64
EMB_FEATURES = [f"e{i:02d}" for i in range(EMB_DIM)]


def f1(spark, sf_dir):
    """Unpaired: lineitem with linestatus F vs O, key l_orderkey (repeats)."""
    li = _t(spark, sf_dir, "lineitem")
    cols = [F.col("l_orderkey").alias("id")] + [F.col(c) for c in LINE_FEATURES]
    d1 = li.where(F.col("l_linestatus") == "F").select(*cols)
    d2 = li.where(F.col("l_linestatus") == "O").select(*cols)
    return d1, d2, RunSpec(id_col="id", dataset1_name="F", dataset2_name="O", mode=COMPARISON)


def f2(spark, sf_dir):
    """Missing values: documents left-joined to labels, English vs the rest."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = _t(spark, sf_dir, "labels")
    j = docs.join(lab, "doc_id", "left")
    cols = [F.col("doc_id").alias("id"), "n_chars", "quality", "toxic"]
    d1 = j.where(F.col("lang") == "en").select(*cols)
    d2 = j.where(F.col("lang") != "en").select(*cols)
    return d1, d2, RunSpec(id_col="id", dataset1_name="en", dataset2_name="other", mode=COMPARISON)


def f3(spark, sf_dir):
    """Key rename and column overlap: customer vs supplier without prefixes."""
    c = _t(spark, sf_dir, "customer")
    s = _t(spark, sf_dir, "supplier")
    d1 = c.select(*[F.col(x).alias(x[2:]) for x in c.columns])
    d2 = s.select(*[F.col(x).alias(x[2:]) for x in s.columns])
    return d1, d2, RunSpec(id_col="id", id_aliases=("custkey", "suppkey"), dataset1_name="customer",
                           dataset2_name="supplier", mode=COMPARISON)


def f4(spark, sf_dir):
    """Paired, low agreement: order total vs the sum of its discounted, taxed lines."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    li = _t(spark, sf_dir, "lineitem")
    d2 = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("amount"))
    return o, d2, RunSpec(id_col="id", dataset1_name="orders", dataset2_name="lines", mode=VALIDATION)


def f5(spark, sf_dir):
    """Paired, high agreement: price vs price rounded to thousands; repeated keys."""
    li = _t(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    d1 = li.select(key, F.col("l_extendedprice").alias("price"))
    d2 = li.select(key, F.round(F.col("l_extendedprice"), -3).alias("price"))
    return d1, d2, RunSpec(id_col="id", dataset1_name="exact", dataset2_name="rounded", mode=VALIDATION)


def f6(spark, sf_dir):
    """Paired, identical: stored n_chars vs length(text)."""
    d = _t(spark, sf_dir, "documents")
    d1 = d.select(F.col("doc_id").alias("id"), F.col("n_chars"))
    d2 = d.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n_chars"))
    return d1, d2, RunSpec(id_col="id", dataset1_name="stored", dataset2_name="measured", mode=VALIDATION)


def f7(spark, sf_dir):
    """Wide matrix: 64 embedding coordinates, label < 5 vs >= 5."""
    e = _t(spark, sf_dir, "embeddings")
    cols = [F.col("vec_id").alias("id")] + [F.col("embedding")[i].cast("double").alias(f)
                                            for i, f in enumerate(EMB_FEATURES)]
    d1 = e.where(F.col("label") < 5).select(*cols)
    d2 = e.where(F.col("label") >= 5).select(*cols)
    return d1, d2, RunSpec(id_col="id", dataset1_name="low", dataset2_name="high", mode=COMPARISON)


def f8(spark, sf_dir):
    """Skewed values: event value of views vs purchases."""
    ev = _t(spark, sf_dir, "events")
    cols = [F.col("event_id").alias("id"), F.col("value")]
    d1 = ev.where(F.col("event_type") == "view").select(*cols)
    d2 = ev.where(F.col("event_type") == "purchase").select(*cols)
    return d1, d2, RunSpec(id_col="id", dataset1_name="view", dataset2_name="purchase", mode=COMPARISON)


def _degenerate(df: DataFrame) -> DataFrame:
    near = F.when((F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.09), F.col("l_quantity")).otherwise(F.lit(0.0))
    return df.select("*", F.lit(1.0).alias("k_const"), F.lit(None).cast("double").alias("k_null"),
                     near.alias("k_near"))


def f9(spark, sf_dir):
    """Degenerate columns on top of F1: constant, all-null, 99%+ one value."""
    li = _t(spark, sf_dir, "lineitem")
    cols = [F.col("l_orderkey").alias("id")] + [F.col(c) for c in LINE_FEATURES]
    base = _degenerate(li.select("l_linestatus", *cols))
    d1 = base.where(F.col("l_linestatus") == "F").drop("l_linestatus")
    d2 = base.where(F.col("l_linestatus") == "O").drop("l_linestatus")
    return d1, d2, RunSpec(id_col="id", dataset1_name="F", dataset2_name="O", mode=COMPARISON)


def f10(spark, sf_dir):
    """Collinear columns: quantity, three noisy copies (r above 0.9, 0.95 and 0.99), and the sum of two of them."""
    li = _t(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("double")
    near, mid = q + 60.0 * F.col("l_discount").cast("double"), q + 120.0 * F.col("l_tax").cast("double")
    cols = [F.col("l_orderkey").alias("id"), q.alias("qty"), near.alias("qty_near"), mid.alias("qty_mid"),
            (q + 2.5 * F.col("l_linenumber")).alias("qty_far"), (near + mid).alias("blend")]
    d1 = li.where(F.col("l_linestatus") == "F").select(*cols)
    d2 = li.where(F.col("l_linestatus") == "O").select(*cols)
    return d1, d2, RunSpec(id_col="id", dataset1_name="F", dataset2_name="O", mode=COMPARISON)


def f11(spark, sf_dir):
    """Paired with missing values on both sides: the quantity of a line against versions of all five agreement classes, and one that
    few lines have."""
    li = _t(spark, sf_dir, "lineitem")
    q, odd = F.col("l_quantity").cast("double"), F.when(F.col("l_linenumber") % 2 == 1, 1.0).otherwise(-1.0)
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    here = F.when(F.col("l_linenumber") != 3, q)
    there = F.col("l_orderkey") % 5 != 0
    few = F.col("l_orderkey") <= 2
    d1 = li.select(key, here.alias("close"), here.alias("near"), q.alias("off"), q.alias("far"), here.alias("turned"),
                   F.when(few, q).alias("rare"))
    d2 = li.select(key, F.when(there, q + 0.001 * F.col("l_linenumber")).alias("close"), F.when(there, q * (1 + 0.07 * odd)).alias("near"),
                   (q * (1 + 0.15 * odd)).alias("off"), F.when(there, q * (1 + 0.3 * odd)).alias("far"), (51 - q).alias("turned"),
                   F.when(few, q + 1).alias("rare"))
    return d1, d2, RunSpec(id_col="id", dataset1_name="first", dataset2_name="second", mode=VALIDATION)


FIXTURES = {"f1": f1, "f2": f2, "f3": f3, "f4": f4, "f5": f5, "f6": f6, "f7": f7, "f8": f8, "f9": f9, "f10": f10, "f11": f11}

_LINE = ", ".join(LINE_FEATURES)
_EMB = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(EMB_FEATURES))
_COPIES = ("CAST(l_quantity AS DOUBLE) AS qty, CAST(l_quantity AS DOUBLE) + 60.0::DOUBLE * CAST(l_discount AS DOUBLE) AS qty_near, "
           "CAST(l_quantity AS DOUBLE) + 120.0::DOUBLE * CAST(l_tax AS DOUBLE) AS qty_mid, "
           "CAST(l_quantity AS DOUBLE) + 2.5::DOUBLE * l_linenumber AS qty_far, "
           "(CAST(l_quantity AS DOUBLE) + 60.0::DOUBLE * CAST(l_discount AS DOUBLE)) + "
           "(CAST(l_quantity AS DOUBLE) + 120.0::DOUBLE * CAST(l_tax AS DOUBLE)) AS blend")
_NEAR = "CASE WHEN l_quantity >= 49 AND l_discount >= 0.09 THEN l_quantity ELSE 0.0 END"

# DuckDB definitions of the same pairs: (d1 select, d2 select)
FIXTURE_SQL = {
    "f1": (f"SELECT l_orderkey AS id, {_LINE} FROM lineitem WHERE l_linestatus = 'F'",
           f"SELECT l_orderkey AS id, {_LINE} FROM lineitem WHERE l_linestatus = 'O'"),
    "f2": ("SELECT d.doc_id AS id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l "
           "ON d.doc_id = l.doc_id WHERE lang = 'en'",
           "SELECT d.doc_id AS id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l "
           "ON d.doc_id = l.doc_id WHERE lang <> 'en'"),
    "f3": ("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, "
           "c_mktsegment AS mktsegment FROM customer",
           "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier"),
    "f4": ("SELECT o_orderkey AS id, o_totalprice AS amount FROM orders",
           "SELECT l_orderkey AS id, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS amount "
           "FROM lineitem GROUP BY l_orderkey"),
    "f5": ("SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS price FROM lineitem",
           "SELECT l_orderkey * 10 + l_linenumber AS id, round(l_extendedprice, -3) AS price FROM lineitem"),
    "f6": ("SELECT doc_id AS id, n_chars FROM documents",
           "SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n_chars FROM documents"),
    "f7": (f"SELECT vec_id AS id, {_EMB} FROM embeddings WHERE label < 5",
           f"SELECT vec_id AS id, {_EMB} FROM embeddings WHERE label >= 5"),
    "f8": ("SELECT event_id AS id, value FROM events WHERE event_type = 'view'",
           "SELECT event_id AS id, value FROM events WHERE event_type = 'purchase'"),
    "f9": (f"SELECT l_orderkey AS id, {_LINE}, 1.0::DOUBLE AS k_const, NULL::DOUBLE AS k_null, "
           f"({_NEAR})::DOUBLE AS k_near FROM lineitem WHERE l_linestatus = 'F'",
           f"SELECT l_orderkey AS id, {_LINE}, 1.0::DOUBLE AS k_const, NULL::DOUBLE AS k_null, "
           f"({_NEAR})::DOUBLE AS k_near FROM lineitem WHERE l_linestatus = 'O'"),
}
FIXTURE_SQL["f10"] = tuple(f"SELECT l_orderkey AS id, {_COPIES} FROM lineitem WHERE l_linestatus = '{s}'" for s in "FO")
_ODD = "CASE WHEN l_linenumber % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_Q = "CAST(l_quantity AS DOUBLE)"
FIXTURE_SQL["f11"] = (
    f"SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <> 3 THEN {_Q} END AS close, "
    f"CASE WHEN l_linenumber <> 3 THEN {_Q} END AS near, {_Q} AS off, {_Q} AS far, "
    f"CASE WHEN l_linenumber <> 3 THEN {_Q} END AS turned, CASE WHEN l_orderkey <= 2 THEN {_Q} END AS rare FROM lineitem",
    f"SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 5 <> 0 THEN {_Q} + 0.001::DOUBLE * l_linenumber END AS close, "
    f"CASE WHEN l_orderkey % 5 <> 0 THEN {_Q} * (1 + 0.07::DOUBLE * ({_ODD})) END AS near, "
    f"{_Q} * (1 + 0.15::DOUBLE * ({_ODD})) AS off, CASE WHEN l_orderkey % 5 <> 0 THEN {_Q} * (1 + 0.3::DOUBLE * ({_ODD})) END AS far, "
    f"51 - {_Q} AS turned, CASE WHEN l_orderkey <= 2 THEN {_Q} + 1 END AS rare FROM lineitem")

# numeric features of each fixture after the overlap projection (sorted)
FIXTURE_FEATURES = {
    "f1": sorted(LINE_FEATURES),
    "f2": ["n_chars", "quality", "toxic"],
    "f3": ["acctbal", "nationkey"],
    "f4": ["amount"],
    "f5": ["price"],
    "f6": ["n_chars"],
    "f7": EMB_FEATURES,
    "f8": ["value"],
    "f9": sorted(LINE_FEATURES + ["k_const", "k_null", "k_near"]),
    "f11": sorted(["close", "near", "off", "far", "turned", "rare"]),
    "f10": sorted(["qty", "qty_near", "qty_mid", "qty_far", "blend"]),
}
