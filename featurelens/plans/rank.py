"""Exact ranks and quantiles without one task per group.

Input rows are distinct ``(keys, value)`` with weight columns (typically the value counts of each dataset).  A plain
``Window.partitionBy(keys).orderBy(value)`` would put a whole feature into one task, so values are dealt to ranges.  The range is a
function of the value: the number of bounds at or below it (``ranged``).  Bounds are approximate quantiles, found by one aggregate and
kept as constants (groups x ranges numbers, whatever the data), so every branch of a plan and every retried task finds the
same ranges and nothing is written.  They only balance the work; results are exact whatever they are.

``cumulate`` adds running sums: a window inside (keys, range) plus the exact total of lower ranges.  ``group_quantiles`` needs no
full ranking: the totals of ranges tell which ranges hold the wanted ranks, and only their rows are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds on the ranges of a group, and the accuracy of its bounds, in ranges.
FEWEST, MOST, ACCURACY = 16, 4096, 20


def local(df: DataFrame) -> DataFrame:
    """A small table computed now and kept as constants: plans that read it do not repeat its own."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def ranged(df: DataFrame, keys: list, value: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_b``, the range of ``value`` in its group.

    A group has about ``buckets`` ranges; by default twice as many as shuffle partitions.  Bounds are looked up in two steps of a
    square root each.
    """
    n = buckets or min(MOST, max(FEWEST, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    side = max(2, math.ceil(math.sqrt(n)))
    n = side * side
    v = F.col(value).cast("double")
    every = F.percentile_approx(v, [i / n for i in range(1, n)], ACCURACY * n)
    table = local(df.groupBy(*keys).agg(every.alias("_e")))
    bounds = local(table.select(
        *keys, F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.element_at("_e", i * side)).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda c: F.slice("_e", c * side + 1, side - 1)).alias("_fine")))
    joined = df.join(F.broadcast(bounds), keys, "left")
    part = F.coalesce(F.size(F.filter("_coarse", lambda b: b <= v)), F.lit(0))
    joined = joined.withColumn("_c", part)
    inside = F.coalesce(F.size(F.filter(F.element_at("_fine", F.col("_c") + 1), lambda b: b <= v)), F.lit(0))
    return joined.select(*df.columns, (F.col("_c") * side + inside).alias("_b"))


def cumulate(df: DataFrame, keys: list, value: str, weights: list, buckets: int | None = None) -> DataFrame:
    """Running sums ``cum_<w>`` (inclusive) and totals ``tot_<w>`` per ``keys``, and the range ``_b``.

    ``(keys, value)`` must be unique in ``df``, which is read several times: keep it where it costs much.  It may be ranged already.
    """
    b = df if "_b" in df.columns else ranged(df, keys, value, buckets)
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(w).alias(f"_bt_{w}") for w in weights])
    w_prev, w_all = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys)
    # groups x ranges numbers, kept as constants: joined to itself, a kept ``df`` would be computed anew for either side
    offsets = local(totals.select(*keys, "_b", *[
        (F.sum(f"_bt_{w}").over(w_prev) - F.col(f"_bt_{w}")).alias(f"_off_{w}") for w in weights], *[
        F.sum(f"_bt_{w}").over(w_all).alias(f"tot_{w}") for w in weights]))
    w_run = Window.partitionBy(*keys, "_b").orderBy(value)
    run = b.select("*", *[F.sum(w).over(w_run).alias(f"_run_{w}") for w in weights])
    out = run.join(F.broadcast(offsets), [*keys, "_b"])
    return out.select(*[c for c in df.columns if c != "_b"], "_b", *[(F.col(f"_run_{w}") + F.col(f"_off_{w}")).alias(f"cum_{w}") for w in weights],
                      *[f"tot_{w}" for w in weights])


def _targets(spans: DataFrame, keys: list, probs: list) -> DataFrame:
    """The wanted 0-based ranks floor((N-1)q) and the next one, each in the range (``_s0`` to ``_s1``, of ``_n``) that holds it."""
    h = (F.col("_n") - 1) * F.col("q")
    return (spans.where(F.col("_s1") > F.col("_s0"))
            .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
            .withColumn("_lo", F.floor(h).cast("long"))
            .withColumn("_t", h - F.col("_lo"))
            .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
            .withColumn("_r", F.explode(F.array("_lo", "_hi")))
            .where((F.col("_r") >= F.col("_s0")) & (F.col("_r") < F.col("_s1")))
            .select(*keys, "_b", "_s0", "q", "_t", "_lo", "_hi", "_r"))


def _interpolated(rows: DataFrame, tgt: DataFrame, keys: list, value: str, weight: str, cum: str) -> DataFrame:
    """(keys, q, quantile) from the rows around the wanted ranks; a row meets only its range's targets (groups x probabilities)."""
    hit = rows.select(*keys, "_b", value, weight, cum).join(F.broadcast(tgt), [*keys, "_b"]) \
              .where((F.col("_r") >= F.col(cum) - F.col(weight)) & (F.col("_r") < F.col(cum)))
    agg = hit.groupBy(*keys, "q", "_t").agg(
        F.max(F.when(F.col("_r") == F.col("_lo"), F.col(value))).alias("_va"),
        F.max(F.when(F.col("_r") == F.col("_hi"), F.col(value))).alias("_vb"))
    a, b, t = F.col("_va").cast("double"), F.col("_vb").cast("double"), F.col("_t")
    lerp = F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)
    return agg.select(*keys, "q", lerp.alias("quantile"))


def quantiles(rk: DataFrame, keys: list, value: str, weight: str, probs: list) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy ``linear`` / SQL ``quantile_cont``) of a ``cumulate`` output: (keys, q, quantile)."""
    cum, tot = f"cum_{weight}", f"tot_{weight}"
    rows = rk.where(F.col(weight) > 0)
    spans = rows.groupBy(*keys, "_b").agg(F.min(F.col(cum) - F.col(weight)).alias("_s0"),
                                          F.max(F.col(cum)).alias("_s1"), F.max(tot).alias("_n"))
    return _interpolated(rows, local(_targets(spans, keys, probs)), keys, value, weight, cum)


def group_quantiles(df: DataFrame, keys: list, value: str, weights: list, probs: list, buckets: int | None = None,
                    rk: DataFrame | None = None) -> DataFrame:
    """Exact quantiles of ``value`` weighted by each of ``weights`` per ``keys``: (keys, w, q, quantile), ``w`` = index of the weight column.

    From ``rk``, a full ranking, where there is one; otherwise only the ranges that hold a wanted rank are ordered.  Rows of ``df``
    may then share a value; it is read three times, and may be ranged already.
    """
    if rk is not None:  # all weights in one pass: in a union of its branches a kept ``rk`` would be computed anew
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.col(w).cast("long").alias("_wt"), F.col(f"cum_{w}").alias("_cum"),
                                            F.col(f"tot_{w}").alias("_n")) for i, w in enumerate(weights)])).alias("_x")
        ranks = rk.select(*keys, value, "_b", each).select(*keys, value, "_b", "_x.*").where(F.col("_wt") > 0)
        spans = ranks.groupBy(*keys, "w", "_b").agg(F.min(F.col("_cum") - F.col("_wt")).alias("_s0"), F.max("_cum").alias("_s1"),
                                                    F.max("_n").alias("_n"))
        tgt = local(_targets(spans, [*keys, "w"], probs))
        return _interpolated(ranks, tgt, [*keys, "w"], value, "_wt", "_cum")
    b = df if "_b" in df.columns else ranged(df, keys, value, buckets)
    by_weight = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.col(w).cast("long").alias("_wt"))
                                    for i, w in enumerate(weights)])).alias("_x")
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(w).alias(w) for w in weights]).select(*keys, "_b", by_weight).select(
        *keys, "_b", "_x.*")
    of = Window.partitionBy(*keys, "w")
    spans = totals.select(*keys, "w", "_b", F.sum("_wt").over(of.orderBy("_b")).alias("_s1"), F.sum("_wt").over(of).alias("_n"),
                          "_wt").withColumn("_s0", F.col("_s1") - F.col("_wt"))
    wanted = [*keys, "w"]
    tgt = local(_targets(spans, wanted, probs))  # two rows for each group, weight and probability
    start = tgt.select(*wanted, "_b", "_s0").distinct()
    rows = b.select(*keys, value, "_b", by_weight).select(*keys, value, "_b", "_x.*").where(F.col("_wt") > 0)
    rows = rows.join(F.broadcast(start), [*wanted, "_b"])
    run = Window.partitionBy(*wanted, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.col("_s0") + F.sum("_wt").over(run))
    return _interpolated(rows, tgt, wanted, value, "_wt", "_cum")
