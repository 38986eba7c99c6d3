"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import new_folder, written  # noqa: F401  (new_folder: for operators that write files)

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what follows is computed from
    the files, so that a lost executor does not repeat the work before them."""
    return written(df, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
