"""Connected components by min-label propagation with pointer jumping, in Spark.

Labels and links stay distributed; each round's labels are written to the shared folder, which cuts the
lineage.  Rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``comp``, the smallest node reachable, of every node that has a link."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("comp")), "labels")
    while True:
        heard = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("__heard"))
        told = labels.join(heard, labels["node"] == heard["u"]).select(
            "node", F.col("comp").alias("__old"), F.least("comp", "__heard").alias("__new"))
        up = labels.select(F.col("node").alias("__up"), F.col("comp").alias("__jump"))
        jumped = told.join(up, F.col("__new") == F.col("__up")).select(
            "node", "__old", F.least("__new", "__jump").alias("comp"))
        jumped = stored(jumped, "labels")
        if not jumped.where("__old != comp").limit(1).count():
            return jumped.select("node", "comp")
        labels = jumped.select("node", "comp")
