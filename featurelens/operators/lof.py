"""Local Outlier Factor (O6): density of each row against that of its neighbourhood.

Neighbourhoods are exact (``plans.knn``): all rows up to the distance of the k-th nearest, ties included, so the factor does not depend on
the order of rows; without ties they are the k nearest.  Equal rows are one weighted point, so a vector that a third of
the rows share is one point of its cell.  ``reach(p, o) = max(k-distance(o), d(p, o))``; the density of ``p`` is the inverse of the mean
reach of its neighbours, plus 1e-10 against division by zero; the factor is the mean density of the neighbours divided by its own.
Rows whose factor exceeds the (1 - contamination) quantile are flagged.

Pairs of neighbours are never rows of a table.  The task that finds a cell's neighbours (``knn.found``) knows the k-distances of the cell's own
points, so it leaves sums over these, a list of neighbours for each point, and distances only of neighbours in the halo.  K-distances and
then densities of the halo's points are sent to the cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import knn
from ..plans.rank import group_quantiles
from ..plans.store import written
from ..plans.tables import Tables, ds_name
from .multivariate import scaled_matrix, scaled_vectors

NEIGHBOURS = 20
LEAST = 1e-10
P, O, CELL = ["ds", "cell", "at"], ["ds", "ocell", "oat"], ["ds", "cell"]


def _points(t: Tables) -> DataFrame:
    """Distinct vectors of the datasets that have enough rows, with the number of rows of each."""
    enough = [d for d, n in t.rows.items() if n >= t.spec.thresholds.min_multivariate_rows]
    return scaled_vectors(t).where(F.col("ds").isin(enough)).select("ds", F.array(*t.matrix_features).alias("x"), "w")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and of each the number of its list."""
    lists = column.combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def _keys(key: tuple, n: int) -> list[pa.Array]:
    return [pa.array(np.full(n, v.as_py(), np.int32)) for v in key]


def _links(home: DataFrame, halo: DataFrame, dims: int, k: int) -> DataFrame:
    """Of each point (``ds, cell, at, w``): ``kd``, ``n`` (rows of its neighbours), ``own`` (sum of the reach of its neighbours in its cell),
    ``near`` and ``far`` (numbers of its neighbours in the cell and in the halo) and ``d`` (distances of the latter)."""
    def linked(key: tuple, own: pa.Table, beyond: pa.Table) -> pa.Table:
        who, to, d, weight, kd, w, *_ = knn.found(own, beyond, dims, k)
        n, inside = len(kd), to < len(kd)
        reach = np.maximum(d[inside], kd[to[inside]]) * weight[inside]
        return pa.table([*_keys(key, n), pa.array(np.arange(n, dtype=np.int32)), pa.array(w), pa.array(kd),
                         pa.array(np.bincount(who, weight, n)), pa.array(np.bincount(who[inside], reach, n)),
                         knn.listed(who[inside], to[inside].astype(np.int32), n),
                         knn.listed(who[~inside], (to[~inside] - n).astype(np.int32), n), knn.listed(who[~inside], d[~inside], n)],
                        names=["ds", "cell", "at", "w", "kd", "n", "own", "near", "far", "d"])

    return home.groupBy(*CELL).cogroup(halo.groupBy(*CELL)).applyInArrow(
        linked, "ds int, cell int, at int, w long, kd double, n double, own double, near array<int>, far array<int>, d array<double>")


def _densities(links: DataFrame, beyond: DataFrame) -> DataFrame:
    """(ds, cell, at, w, lrd); ``beyond``: the halos' points with their ``kd``."""
    def border(key: tuple, rows: pa.Table, halo: pa.Table) -> pa.Table:
        _, _, (weights, kd) = knn.numbered(halo, "w", "kd")
        (far, who), (d, _), n = _lists(rows["far"]), _lists(rows["d"]), rows.num_rows
        reach = np.bincount(who, np.maximum(d, kd.to_numpy()[far]) * weights.to_numpy()[far], n) + rows["own"].to_numpy()
        return pa.table([*_keys(key, n), rows["at"], rows["w"], pa.array(1 / (reach / rows["n"].to_numpy() + LEAST))],
                        names=["ds", "cell", "at", "w", "lrd"])

    some = links.where(F.size("far") > 0).select(*P, "w", "n", "own", "far", "d")
    of = some.groupBy(*CELL).cogroup(beyond.groupBy(*CELL)).applyInArrow(border, "ds int, cell int, at int, w long, lrd double")
    return links.where(F.size("far") == 0).select(*P, "w", (1 / (F.col("own") / F.col("n") + LEAST)).alias("lrd")).unionByName(of)


def _factors(links: DataFrame, densities: DataFrame) -> DataFrame:
    """(ds, cell, at, w, n_neighbours, k_distance, lof); ``densities`` (``ds, cell, ocell, oat, w, lrd``): of a cell's points and its halo's."""
    def factors(key: tuple, rows: pa.Table, values: pa.Table) -> pa.Table:
        rows, n = rows.sort_by("at"), rows.num_rows
        cells = values["ocell"].to_numpy()
        mine = cells == key[1].as_py()
        own = values.filter(pa.array(mine)).sort_by("oat")
        w, lrd = own["w"].to_numpy(), own["lrd"].to_numpy()
        _, _, (weights, dense) = knn.numbered(values.filter(pa.array(~mine)), "w", "lrd")
        (near, one), (far, other) = _lists(rows["near"]), _lists(rows["far"])
        around = np.bincount(one, (w[near] - (near == one)) * lrd[near], n)
        around = around + np.bincount(other, weights.to_numpy()[far] * dense.to_numpy()[far], n)
        total = rows["n"].to_numpy()
        return pa.table([*_keys(key, n), rows["at"], rows["w"], pa.array(total.astype(np.int64)), rows["kd"], pa.array(around / total / lrd)],
                        names=["ds", "cell", "at", "w", "n_neighbours", "k_distance", "lof"])

    return links.select(*P, "w", "kd", "n", "near", "far").groupBy(*CELL).cogroup(densities.groupBy(*CELL)).applyInArrow(
        factors, "ds int, cell int, at int, w long, n_neighbours long, k_distance double, lof double").where(F.col("k_distance") < np.inf)


def lof_points(t: Tables, k: int = NEIGHBOURS, cell: int = knn.CELL, vectors: bool = True) -> DataFrame:
    """(ds, x, w, n_neighbours, k_distance, lof): one row per distinct vector ``x`` of the imputed, scaled matrix, shared by ``w`` rows.
    Without ``vectors`` points are named by ``cell`` and ``at`` instead."""
    dims = len(t.matrix_features)
    home, halo, _ = knn.halos(_points(t), dims, k, cell)
    links = written(_links(home, halo, dims, k), "links")
    beyond = halo.select("ds", "cell", "ocell", "oat", "w")
    of = {"cell": "ocell", "at": "oat"}
    dense = written(_densities(links, beyond.join(links.select(*P, "kd").withColumnsRenamed(of), O)), "densities")
    own = dense.select(*CELL, F.col("cell").alias("ocell"), F.col("at").alias("oat"), "w", "lrd")
    out = _factors(links, own.unionByName(beyond.join(dense.drop("w").withColumnsRenamed(of), O)))
    return home.select(*P, "x").join(out, P).drop("cell", "at") if vectors else out


def lof_flags(t: Tables, k: int = NEIGHBOURS, cell: int = knn.CELL, vectors: bool = False) -> DataFrame:
    """Points with ``is_outlier``: above the linear (1 - contamination) quantile over all rows (to nine digits)."""
    points = t.hold(lof_points(t, k, cell, vectors))
    thr = group_quantiles(points.select("ds", "lof", "w"), ["ds"], "lof", ["w"], [1 - t.spec.thresholds.outlier_contamination],
                          t.spec.rank_buckets)
    return points.join(F.broadcast(thr.select("ds", F.col("quantile").alias("_thr"))), "ds").withColumn(
        "is_outlier", F.col("lof") > F.col("_thr") * knn.TIE).drop("_thr")


def lof_rows(t: Tables, x: DataFrame, k: int = NEIGHBOURS, cell: int = knn.CELL) -> DataFrame:
    """``ds, id, h1, h2, n_neighbours, k_distance, lof, is_outlier`` of every row of the scaled matrix: its vector's."""
    rows = x.select("ds", "id", F.col("_rk.h1").alias("h1"), F.col("_rk.h2").alias("h2"), F.array(*t.matrix_features).alias("x"))
    return rows.join(lof_flags(t, k, cell, True), ["ds", "x"]).drop("x", "w")


def lof_scores(t: Tables) -> DataFrame:
    """O6 as a report: (Dataset, id, Neighbours, K_Distance, LOF, Is_Outlier), one row per record."""
    x, _ = scaled_matrix(t)
    return lof_rows(t, x).select(ds_name(t.spec).alias("Dataset"), "id", F.col("n_neighbours").alias("Neighbours"),
                                 F.col("k_distance").alias("K_Distance"), F.col("lof").alias("LOF"),
                                 F.col("is_outlier").alias("Is_Outlier"))
