"""Correlation matrices (C1-C6): Pearson, Spearman, Kendall tau-b, high pairs.

* Pearson: pairwise-complete Gram pass (``plans.gram``), p^2 output.
* Spearman: pairs are ranked on their complete rows, as ``DataFrame.corr`` does.  Columns are grouped by which rows they miss
  (``null_classes``); one pass over value counts, with a weight for each class, gives a value's rank
  among the rows where that class is present, for all classes at once: the global count of lower rows less the missing ones among
  them.  So a row has as many ranks a column as there are classes (one without nulls), and the Gram pass takes for each pair of
  classes the ranks that each has under the other.
* Kendall tau-b: exact, from inversions inside bounded buckets and between them (``plans.inversions``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.gram import GRAM_SCHEMA, gram, pearson_from_gram
from ..plans.inversions import ROWS, pair_counts
from ..plans.rank import cumulate
from ..plans.shape import class_counts, present, wide_table
from ..plans.tables import Tables, ds_name

#: Distinct values of all columns up to which tasks look ranks up in constants (8 bytes a value and null class); beyond, rows are joined to them.
LOOKED_UP = 1 << 18
GRAM_NAMES = ["ds", "i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]


def _wide(t: Tables, key: bool = False) -> DataFrame:
    p = t.p
    if not key:
        return wide_table(p)
    parts = []
    for d, df in ((1, p.d1), (2, p.d2)):
        cols = [F.lit(d).alias("ds")] + [F.col(f).cast("double").alias(f) for f in p.features]
        allc = [F.col(c) for c in p.columns]
        # rows are unique after exact dedup; 96 hash bits make the row key
        cols.append(F.struct(F.xxhash64(*allc).alias("h1"), F.hash(*allc).alias("h2")).alias("_rk"))
        parts.append(df.select(*cols))
    return parts[0].unionByName(parts[1])


def _means(t: Tables) -> dict:
    """{ds: {feature: mean}} — 2p numbers, used as the Gram shift."""
    out = {1: {}, 2: {}}
    for r in t.moments.select("ds", "feature", "mean").collect():
        out[r["ds"]][r["feature"]] = r["mean"]
    return out


def _name_pairs(t: Tables, r: DataFrame, method: str) -> DataFrame:
    spark = t.p.d1.sparkSession
    names = spark.createDataFrame(list(enumerate(t.p.features)), "k int, name string")
    n1 = names.withColumnRenamed("k", "i").withColumnRenamed("name", "Feature_1")
    n2 = names.withColumnRenamed("k", "j").withColumnRenamed("name", "Feature_2")
    return (r.join(F.broadcast(n1), "i").join(F.broadcast(n2), "j")
            .select(ds_name(t.spec).alias("Dataset"), F.lit(method).alias("Method"), "Feature_1", "Feature_2",
                    F.col("r").alias("Correlation")))


def pearson_matrix(t: Tables) -> DataFrame:
    """(Dataset, Method, Feature_1, Feature_2, Correlation), upper triangle with diagonal."""
    g = gram(_wide(t), t.p.features, shift=_means(t), pairwise=True)
    return _name_pairs(t, pearson_from_gram(g), "Pearson")


def null_classes(t: Tables) -> list[list[int]]:
    """Columns grouped by the rows that they miss, in both datasets: equal counts and two 64-bit checksums of the rows' keys."""
    feats, marks = t.p.features, []
    for df in (t.p.d1, t.p.d2):
        allc = [F.col(c) for c in t.p.columns]
        keys = [F.xxhash64(*allc), F.xxhash64(F.lit(1), *allc)]
        aggs = [F.count_if(F.col(f).isNull()) for f in feats]
        aggs += [F.bit_xor(F.when(F.col(f).isNull(), k)) for k in keys for f in feats]
        r = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
        marks.append([tuple(r[i::len(feats)]) for i in range(len(feats))])
    found: dict = {}
    for i, mark in enumerate(zip(*marks, strict=True)):
        found.setdefault(mark, []).append(i)
    return list(found.values())


def class_ranks(t: Tables, classes: list[list[int]]) -> DataFrame:
    """(ds, ranks): per row p x k ranks, of each column's value among the rows where each class is present; NaN where there are none."""
    feats, k = t.p.features, len(classes)
    weights = [f"w{b}" for b in range(k)]
    vc = t.hold(class_counts(_wide(t), feats, classes))
    rk = cumulate(vc, ["ds", "feature"], "value", weights, t.spec.rank_buckets)
    rk = rk.select("ds", "feature", "value", *[(F.col(f"cum_{w}") - F.col(w) + (F.col(w) + 1) / 2.0).alias(f"r{b}")
                                               for b, w in enumerate(weights)])
    if vc.count() * k <= LOOKED_UP:
        return looked_up(_wide(t), feats, rk.toArrow(), k)
    # not grouped as arrays but as numbers, which are aggregated by hashing
    long = _wide(t, key=True).select("ds", "_rk.*", *feats).unpivot(["ds", "h1", "h2"], feats, "feature", "value").where(
        F.col("value").isNotNull())
    rows = long.join(rk, ["ds", "feature", "value"]).groupBy("ds", "h1", "h2").agg(
        *[F.max(F.when(F.col("feature") == f, F.col(f"r{b}"))).alias(f"_{i}_{b}") for i, f in enumerate(feats) for b in range(k)])
    none = F.lit(float("nan"))
    return rows.select("ds", F.array(*[F.coalesce(F.col(f"_{i}_{b}"), none) for i in range(len(feats)) for b in range(k)]).alias("ranks"))


def looked_up(wide: DataFrame, feats: list, ranks: pa.Table, k: int) -> DataFrame:
    """(ds, ranks) as ``class_ranks``, of each row of ``wide`` by a look-up of its values among ``ranks``, the ranks of all values."""
    ranks = ranks.sort_by([("ds", "ascending"), ("feature", "ascending"), ("value", "ascending")])
    ds, names, values = (ranks[c].to_numpy() for c in ("ds", "feature", "value"))
    of = np.stack([ranks[f"r{b}"].to_numpy() for b in range(k)], axis=1)
    table = {(d, i): (values[at], of[at]) for d in (1, 2) for i, f in enumerate(feats) for at in [np.flatnonzero((ds == d) & (names == f))]}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, there in present(batches, len(feats)):
            out = np.full((len(x[0]), len(feats), k), np.nan)
            for i, column in enumerate(x):
                known, rank = table[d, i]
                out[there[i], i] = rank[np.searchsorted(known, column[there[i]])]
            flat = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * (len(feats) * k), out.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), d, np.int32)), flat], names=["ds", "ranks"])

    return wide.mapInArrow(find, "ds int, ranks array<double>")


def class_gram(ranks: DataFrame, p: int, classes: list[list[int]]) -> DataFrame:
    """The moments of ``plans.gram`` for all pairs of columns, each ranked under the other's class."""
    k = len(classes)
    sides = [(a, b, np.array(classes[a]), np.array(classes[b])) for a in range(k) for b in range(a, k)]

    def part(batches):
        total: dict = {}
        for batch in batches:
            ds = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, p, k)
            for d in np.unique(ds).tolist():
                mine = x[ds == d]
                for a, b, left, right in sides:
                    u, v = mine[:, left, b], mine[:, right, a]
                    mu, mv = (~np.isnan(u)).astype(float), (~np.isnan(v)).astype(float)
                    u, v = np.where(mu > 0, u, 0), np.where(mv > 0, v, 0)
                    sums = np.stack([mu.T @ mv, u.T @ mv, mu.T @ v, (u * u).T @ mv, mu.T @ (v * v), u.T @ v])
                    total[d, a, b] = total.get((d, a, b), 0) + sums
        out = []
        for (d, a, b), sums in total.items():
            for x, i in enumerate(classes[a]):
                for y, j in enumerate(classes[b]):
                    n, sx, sy, sxx, syy, sxy = sums[:, x, y].tolist()
                    if a != b or i <= j:
                        out.append((d, i, j, n, sx, sy, sxx, syy, sxy) if i <= j else (d, j, i, n, sy, sx, syy, sxx, sxy))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if m < 3 else pa.float64())
                                              for m, c in enumerate(zip(*out, strict=True))], names=GRAM_NAMES)

    parts = ranks.mapInArrow(part, GRAM_SCHEMA)
    return parts.groupBy("ds", "i", "j").agg(*[F.sum(c).alias(c) for c in GRAM_NAMES[3:]])


def spearman_matrix(t: Tables) -> DataFrame:
    """Spearman rho per pair on its complete rows."""
    classes = null_classes(t)
    return _name_pairs(t, pearson_from_gram(class_gram(class_ranks(t, classes), len(t.p.features), classes)), "Spearman")


def kendall_matrix(t: Tables, pairs: list | None = None, rows: int = ROWS) -> DataFrame:
    """C4: exact Kendall tau-b for every pair (or the given (i, j) list, i <= j), pairwise complete."""
    feats = t.p.features
    p = len(feats)
    wanted = list(pairs) if pairs is not None else [(i, j) for i in range(p) for j in range(i, p)]
    c = pair_counts(_wide(t, key=True), feats, wanted, rows)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    conc = n0 - F.col("disc") - F.col("ti") - F.col("tj") + F.col("tij")
    den = F.sqrt(n0 - F.col("ti")) * F.sqrt(n0 - F.col("tj"))
    tau = F.when((F.col("n") >= 2) & (n0 > F.col("ti")) & (n0 > F.col("tj")), (conc - F.col("disc")) / den)
    return _name_pairs(t, c.select("ds", "i", "j", tau.alias("r")), "Kendall")


def correlation_matrices(t: Tables, kendall: bool = True) -> DataFrame:
    """The three matrices as one long table."""
    out = pearson_matrix(t).unionByName(spearman_matrix(t))
    return out.unionByName(kendall_matrix(t)) if kendall else out


def high_correlation_pairs(t: Tables, matrices: DataFrame | None = None) -> DataFrame:
    """Strict upper triangle, |r| > threshold for each configured threshold.

    ``Feature_1`` is the later feature in name order (the column of the
    unstacked upper triangle), ``Feature_2`` the earlier.
    """
    m = matrices if matrices is not None else correlation_matrices(t)
    thr = F.explode(F.array(*[F.lit(float(x)) for x in t.spec.thresholds.correlation_high])).alias("_t")
    m = m.where(F.col("Feature_1") != F.col("Feature_2")).where(F.col("Correlation").isNotNull())
    x = m.select("*", thr).where(F.abs(F.col("Correlation")) > F.col("_t"))
    return x.select("Dataset", "Method", F.concat(F.lit("> "), F.col("_t").cast("string")).alias("Threshold"),
                    F.col("Feature_2").alias("Feature_1"), F.col("Feature_1").alias("Feature_2"),
                    "Correlation").dropDuplicates()
