"""Batch effect (M5-M9): can a classifier tell the two datasets apart?

Pooled median imputation and scaling (P11, P13), a seeded hash split of 70/30
inside each label (P19), Spark ML random forest (100 trees, depth 10 — the
reference's documented fallback; ``GBTClassifier`` on request), hold-out
accuracy (M6), normalised feature importances (M7) and the combined 2-D PCA
view (M9).

Trees see a value only by its bin (at most 32, cut at exact pooled quantiles), so rows of equal bins and label are one weighted row.  The
bootstrap draws units: single rows up to ``UNITS`` training rows, beyond them up to so many equal rows together that there are about
``UNITS``.  Every row counts in every split by its unit's weight, and each test row in the accuracy.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rank import group_quantiles
from ..plans.tables import Tables, ds_name
from .multivariate import pca_fit, pca_scores, scaled_matrix

#: Bins of a feature (the learner's own default), and bootstrap units of the training rows.
BINS, UNITS = 32, 500_000


def _split(x: DataFrame, seed: int, test: float = 0.3) -> tuple:
    u = F.pmod(F.xxhash64(F.col("_rk.h1"), F.col("_rk.h2"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    x = x.withColumn("label", F.when(F.col("ds") == 1, 1.0).otherwise(0.0)).withColumn("_u", u)
    return x.where(F.col("_u") >= test), x.where(F.col("_u") < test)


def bin_bounds(t: Tables) -> dict:
    """{feature: least values of its bins}: all its values and its median, if the values are no more than ``BINS``, else its quantiles."""
    counts = t.vc.select("feature", "value", (F.col("n1") + F.col("n2")).alias("n")).where(F.col("feature").isin(t.matrix_features))
    q = group_quantiles(counts, ["feature"], "value", ["n"], [i / BINS for i in range(1, BINS)], t.spec.rank_buckets).collect()
    few = counts.groupBy("feature").count().where(F.col("count") <= BINS).select("feature")
    values = counts.join(F.broadcast(few), "feature").select("feature", "value").collect()
    bounds: dict = {}
    for r in values:
        bounds.setdefault(r["feature"], set()).add(r["value"])
    whole = set(bounds)
    for r in q:
        if r["feature"] not in whole or r["q"] == 0.5:  # the median stands for missing values
            bounds.setdefault(r["feature"], set()).add(r["quantile"])
    return {f: sorted(b) for f, b in bounds.items()}


def binned_rows(t: Tables) -> tuple:
    """(training rows, test rows) of label, bins and ``n``, the number of rows that share them."""
    feats = t.matrix_features
    x, consts = scaled_matrix(t, pooled=True)
    means, sds = consts[0]
    cuts = bin_bounds(t)
    splits = [[-math.inf, *sorted({(b - means[f]) / sds[f] for b in cuts[f]}), math.inf] for f in feats]
    bins = [f"bin_{f}" for f in feats]
    named = Bucketizer(splitsArray=splits, inputCols=feats, outputCols=bins).transform(x)
    return tuple(t.hold(part.groupBy("label", *bins).agg(F.count(F.lit(1)).cast("double").alias("n")))
                 for part in _split(named, t.spec.seed))


def units(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Weighted rows dealt to units of one row each, or of so many equal rows that there are about ``most`` (and one for each kind of row)."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    size = max(1, math.ceil(total / (most or UNITS)))
    parts = F.ceil(F.col("n") / size)
    dealt = rows.withColumn("unit", F.explode(F.sequence(F.lit(1), parts.cast("int")))).withColumn("weight", F.col("n") / parts)
    keys = [c for c in dealt.columns if c not in ("n", "weight")]
    tasks = max(2, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *keys).sortWithinPartitions(*keys)


def batch_model(t: Tables, model: str = "rf"):
    """Fit the classifier; returns (fitted pipeline, predictions of the test rows, with their number ``n``)."""
    train, test = binned_rows(t)
    va = VectorAssembler(inputCols=[f"bin_{f}" for f in t.matrix_features], outputCol="features")
    if model == "gbt":
        clf = GBTClassifier(maxIter=100, maxDepth=10, stepSize=0.3, seed=t.spec.seed, weightCol="weight")
    else:
        clf = RandomForestClassifier(numTrees=100, maxDepth=10, seed=t.spec.seed, weightCol="weight")
    fit = Pipeline(stages=[va, clf]).fit(units(train))
    return fit, fit.transform(test)


#: How a high accuracy reads, by whether the run is paired.
NOTES = {True: "Note: of records paired by key, high accuracy points to differences in how the values were extracted",
         False: "Note: of unpaired datasets, high accuracy is expected where populations, devices or contexts differ"}


def batch_effect(t: Tables, model: str = "rf") -> tuple:
    """(importance DataFrame (Feature, Importance), report DataFrame (Metric, Value))."""
    spark = t.p.d1.sparkSession
    fit, pred = batch_model(t, model)
    acc = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label", weightCol="n").evaluate(pred)
    imp = fit.stages[-1].featureImportances.toArray()
    rows = sorted(zip(t.matrix_features, map(float, imp)), key=lambda r: (-r[1], r[0]))
    importance = spark.createDataFrame(rows, "Feature string, Importance double")
    notes = ["Note: near 0.5 the datasets cannot be told apart, near 1 they differ systematically", NOTES[t.spec.is_paired]]
    report = spark.createDataFrame([("Classifier accuracy", float(acc))] +
                                   [(f"Top feature {i + 1}: {f}", v) for i, (f, v) in enumerate(rows[:10])] +
                                   [(n, None) for n in notes], "Metric string, Value double")
    return importance, report


def batch_importance(t: Tables) -> DataFrame:
    """M7: Feature, Importance (sums to 1), sorted descending."""
    return batch_effect(t)[0]


def batch_report(t: Tables) -> DataFrame:
    """M6+M8: accuracy, the ten most distinguishing features, and notes on how to read them in the run's mode."""
    return batch_effect(t)[1]


def combined_view(t: Tables) -> DataFrame:
    """M9: PCA-2 of the pooled scaled matrix, fitted on all rows of both datasets; each row once."""
    x, _ = scaled_matrix(t, pooled=True)
    x = t.hold(x)
    pooled = x.withColumn("ds", F.lit(1))
    fit = pca_fit(t, pooled, components=2)
    sc = pca_scores(t, x.withColumn("_ds", F.col("ds")).withColumn("ds", F.lit(1)), fit, 2, ["_ds"])
    return sc.select(ds_name(t.spec, "_ds").alias("Dataset"), "id", "PC1", "PC2")
