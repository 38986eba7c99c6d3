"""Session helpers.

Library code never creates a session; these are for tests, the bench and
local runs.

"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans.store import shared_folder


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder
             .master(f"local[{cores}]")
             .appName("featurelens")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    shared_folder(spark)
    return spark
