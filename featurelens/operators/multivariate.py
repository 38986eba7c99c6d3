"""Multivariate: imputed/scaled matrices (P10-P13), Mahalanobis (O4),
Isolation Forest (O5; O6 is in ``lof``), PCA (M1-M3, O8, M9) and the record-level outlier
summary rows (O7).

The data passes are Spark jobs (one Gram scan, one scoring scan); the p x p
algebra (pseudo-inverse, eigen-decomposition) and the 100 small isolation
trees (256 rows each) are parameter-bounded and run on the driver or in one
``applyInPandas`` group per tree.  What a record-level detector says of a row
is a function of its vector, so the summary counts rows by distinct vector
(``scaled_vectors``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import chi2_ppf
from ..plans.gram import gram, gram_matrix
from ..plans.rank import group_quantiles
from ..plans.store import written
from ..plans.tables import Tables, ds_name


# ------------------------------------------------------------------ matrices
def _medians(t: Tables, pooled: bool) -> dict:
    """{ds: {feature: median}}; pooled = one median over both datasets (P11), else of the features that miss values in the dataset."""
    if not pooled:
        out = {1: {}, 2: {}}
        there = {(r["ds"], r["feature"]): r["n"] for r in t.moments.select("ds", "feature", "n").collect()}
        missing = {(d, f) for d, n in t.rows.items() for f in t.matrix_features if there[d, f] < n}
        if missing:  # else nothing is imputed, and no values need to be counted
            for r in t.percentiles.select("ds", "feature", "p50").collect():
                if (r["ds"], r["feature"]) in missing:
                    out[r["ds"]][r["feature"]] = r["p50"]
        return out
    counts = t.vc.select("feature", "value", (F.col("n1") + F.col("n2")).alias("n"))  # kept in ``t``
    q = group_quantiles(counts, ["feature"], "value", ["n"], [0.5], t.spec.rank_buckets)
    med = {r["feature"]: r["quantile"] for r in q.collect()}
    return {1: med, 2: med}


def _keyed(t: Tables) -> DataFrame:
    """Both tables with ds, the key and a 96-bit row key (rows are unique after dedup)."""
    p = t.p
    parts = []
    for d, df in ((1, p.d1), (2, p.d2)):
        allc = [F.col(c) for c in p.columns]
        parts.append(df.select(F.lit(d).alias("ds"), F.col(p.id_col).alias("id"),
                               F.struct(F.xxhash64(*allc).alias("h1"), F.hash(*allc).alias("h2")).alias("_rk"),
                               *[F.col(f).cast("double").alias(f) for f in p.features]))
    return parts[0].unionByName(parts[1])


def _imputed(t: Tables, pooled: bool = False) -> DataFrame:
    """(ds, id, _rk, features...): missing values replaced by the medians."""
    med = _medians(t, pooled)

    def filled(f):
        if f not in med[1] and f not in med[2]:
            return F.col(f)
        return F.coalesce(F.col(f), F.when(F.col("ds") == 1, F.lit(med[1].get(f))).otherwise(F.lit(med[2].get(f)))).alias(f)

    return _keyed(t).select("ds", "id", "_rk", *[filled(f) for f in t.matrix_features])


def _scaling(t: Tables, imp: DataFrame, pooled: bool = False) -> tuple:
    """(z columns, {ds: (means, sds)}) of the imputed columns; summed once for a run, so that all its matrices agree to the last bit."""
    feats = t.matrix_features
    if pooled not in t._scales:
        grp = [] if pooled else ["ds"]
        st = imp.groupBy(*grp).agg(*[F.avg(f).alias(f"m_{f}") for f in feats],
                                   *[F.stddev_pop(f).alias(f"s_{f}") for f in feats]).collect()
        consts = {}
        for r in st:
            d = r["ds"] if not pooled else 0
            consts[d] = ({f: r[f"m_{f}"] for f in feats},
                         {f: (r[f"s_{f}"] if r[f"s_{f}"] and r[f"s_{f}"] > 0 else 1.0) for f in feats})
        t._scales[pooled] = consts
    consts = t._scales[pooled]

    def z(f):
        if pooled:
            m, s = consts[0][0][f], consts[0][1][f]
            return ((F.col(f) - F.lit(m)) / F.lit(s)).alias(f)
        e = None
        for d, (m, s) in consts.items():
            term = (F.col(f) - F.lit(m[f])) / F.lit(s[f])
            e = F.when(F.col("ds") == d, term) if e is None else e.when(F.col("ds") == d, term)
        return e.alias(f)

    return [z(f) for f in feats], consts


def scaled_matrix(t: Tables, pooled: bool = False) -> tuple:
    """(DataFrame ds, id, _rk, features..., constants) — median-imputed, z-scaled (population SD).

    Per dataset (P12+P13) or pooled over both (P11+P13, the batch-effect
    matrix).  Zero SD scales by 1, like ``StandardScaler``.  Returns the
    frame and {ds: (means, sds)} of the imputed columns.
    """
    imp = _imputed(t, pooled)
    z, consts = _scaling(t, imp, pooled)
    return imp.select("ds", "id", "_rk", *z), consts


def scaled_vectors(t: Tables) -> DataFrame:
    """(ds, features..., w): the distinct rows of the scaled matrix of each dataset, each with the number of rows that share it.

    Grouped and written (once for a run) before scaling: written columns of few values are small.
    """
    if t._vectors is None:
        imp = _imputed(t)
        z, _ = _scaling(t, imp)
        counted = imp.groupBy("ds", *t.matrix_features).agg(F.count(F.lit(1)).alias("w"))
        t._vectors = written(counted, "vectors").select("ds", *z, "w")
    return t._vectors


def _scored(rows: DataFrame, feats: list, name: str, of: Callable) -> DataFrame:
    """``rows`` with the column ``name`` in place of the features: ``of(ds, values)`` for the rows of a dataset in an Arrow batch."""
    held = [c for c in rows.columns if c not in feats]
    rows = rows.select(*held, *feats)
    schema = T.StructType([*rows.schema.fields[:len(held)], T.StructField(name, T.DoubleType())])
    at = held.index("ds")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds = batch.column(at).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(held):]], axis=1)
            out = np.empty(len(ds))
            for d in np.unique(ds).tolist():
                out[ds == d] = of(d, values[ds == d])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(held)], pa.array(out, from_pandas=True)], names=schema.names)

    return rows.mapInArrow(scored, schema)


# --------------------------------------------------------------- Mahalanobis
def _cov(x: DataFrame, feats: list) -> dict:
    """{ds: (mean vector, sample covariance)} from one Gram scan; a row counts ``w`` times if there is such a column."""
    rows = gram(x, feats, shift=None, pairwise=False, weight="w" if "w" in x.columns else None).collect()
    sxy = gram_matrix(rows, len(feats), "sxy")
    sx = gram_matrix(rows, len(feats), "sx")
    nn = gram_matrix(rows, len(feats), "n")
    out = {}
    for d in sxy:
        n = nn[d][0, 0]
        mu = np.diag(sx[d]) / n              # diagonal entries hold sum x_i
        cov = (sxy[d] - n * np.outer(mu, mu)) / (n - 1)
        out[d] = (mu, cov, n)
    return out


def _flat(x: DataFrame, feats: list) -> DataFrame:
    return x.select("ds", F.col("_rk.h1").alias("h1"), F.col("_rk.h2").alias("h2"), *feats)


def _distances(t: Tables, x: DataFrame) -> DataFrame:
    """``x`` with ``md``, the distance by the pseudo-inverse of its sample covariance, and ``is_outlier`` in place of the features."""
    feats = t.matrix_features
    cv = _cov(x, feats)
    alpha = t.spec.thresholds.mahalanobis_alpha
    thr = float(np.sqrt(chi2_ppf(1 - alpha, len(feats))))
    params = {d: (mu, np.linalg.pinv(cov)) for d, (mu, cov, n) in cv.items()}

    def distance(d: int, values: np.ndarray) -> np.ndarray:
        mu, pinv = params[d]
        diff = values - mu
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", diff @ pinv, diff), 0))

    return _scored(x, feats, "md", distance).withColumn("is_outlier", F.col("md") > thr)


def mahalanobis_flags(t: Tables, x: DataFrame | None = None) -> DataFrame:
    """(ds, h1, h2, md, is_outlier): distance with the pseudo-inverse of the sample covariance."""
    if x is None:
        x, _ = scaled_matrix(t)
    return _distances(t, _flat(x, t.matrix_features))


# ------------------------------------------------------------------------ PCA
def pca_fit(t: Tables, x: DataFrame | None = None, components: int = 10) -> dict:
    """{ds: (components k x p, explained variance, ratio, mean)} — sklearn conventions (ddof=1, sign flip)."""
    feats = t.matrix_features
    if x is None:
        x, _ = scaled_matrix(t)
    cv = _cov(x, feats)
    out = {}
    for d, (mu, cov, n) in cv.items():
        if n < t.spec.thresholds.min_pca_rows:
            continue
        w, v = np.linalg.eigh(cov)
        order = np.argsort(w)[::-1]
        w, v = np.clip(w[order], 0, None), v[:, order]
        k = min(components, len(feats), int(n))
        comp = v[:, :k].T
        for i in range(k):  # largest |entry| of each component positive
            j = np.argmax(np.abs(comp[i]))
            if comp[i, j] < 0:
                comp[i] = -comp[i]
        total = w.sum()
        out[d] = (comp, w[:k], w[:k] / total if total > 0 else np.zeros(k), mu)
    return out


def pca_loadings(t: Tables) -> DataFrame:
    """M2: (Dataset, Feature, Component, Loading) = component x sqrt(explained variance)."""
    fit = pca_fit(t)
    rows = []
    for d, (comp, ev, ratio, mu) in fit.items():
        for k in range(comp.shape[0]):
            for i, f in enumerate(t.matrix_features):
                rows.append((d, f, f"PC{k + 1}", float(comp[k, i] * np.sqrt(ev[k]))))
    df = t.p.d1.sparkSession.createDataFrame(rows, "ds int, Feature string, Component string, Loading double")
    return df.select(ds_name(t.spec).alias("Dataset"), "Feature", "Component", "Loading")


def pca_variance(t: Tables) -> DataFrame:
    """M3: (Dataset, Component, Explained_Variance, Explained_Variance_Ratio, Cumulative_Ratio)."""
    fit = pca_fit(t)
    rows = []
    for d, (comp, ev, ratio, mu) in fit.items():
        cum = np.cumsum(ratio)
        rows += [(d, k + 1, float(ev[k]), float(ratio[k]), float(cum[k])) for k in range(len(ev))]
    df = t.p.d1.sparkSession.createDataFrame(
        rows, "ds int, Component int, Explained_Variance double, Explained_Variance_Ratio double, Cumulative_Ratio double")
    return df.select(ds_name(t.spec).alias("Dataset"), "Component", "Explained_Variance", "Explained_Variance_Ratio",
                     "Cumulative_Ratio")


def pca_scores(t: Tables, x: DataFrame, fit: dict, k: int = 2, carry: list = ()) -> DataFrame:
    """M1: (ds, id, _rk, carried columns, PC1..PCk): one matrix product per Arrow batch; null where a dataset has fewer components."""
    feats = t.matrix_features
    rows = x.select("ds", "id", "_rk", *carry, *feats)
    held = len(rows.columns) - len(feats)
    schema = T.StructType([*rows.schema.fields[:held], *[T.StructField(f"PC{c + 1}", T.DoubleType()) for c in range(k)]])
    parts = {d: (mu, comp[:k].T) for d, (comp, _, _, mu) in fit.items()}

    def scored(batches):
        for batch in batches:
            ds = batch.column(0).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[held:]], axis=1)
            out = np.full((len(ds), k), np.nan)
            for d, (mu, comp) in parts.items():
                out[ds == d, :comp.shape[1]] = (values[ds == d] - mu) @ comp
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], *[pa.array(out[:, c], from_pandas=True) for c in range(k)]],
                                             names=schema.names)

    return rows.mapInArrow(scored, schema)


def pca_identities(t: Tables, components: int = 10) -> DataFrame:
    """What the scores must keep, by dataset (Dataset, Item, Value): the total of their variances, the sum of all squared covariances
    (of the scaled features, if there are no more than ``components``), and the largest covariance of two of them, to 9 places."""
    x, _ = scaled_matrix(t)
    x = t.hold(x)
    fit = pca_fit(t, x, components)
    k = max(comp.shape[0] for comp, *_ in fit.values())
    names = [f"PC{c + 1}" for c in range(k)]
    g = gram(pca_scores(t, x, fit, k), names, pairwise=False)
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
    c = g.select("ds", "i", "j", cov.alias("c"))
    off = F.when(F.col("i") < F.col("j"), F.col("c"))
    one = c.groupBy("ds").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("total"),
                              F.sum(F.when(F.col("i") == F.col("j"), F.col("c") * F.col("c")).otherwise(2 * F.col("c") * F.col("c")))
                              .alias("squares"), (F.round(F.max(F.abs(off)), 9) + 0.0).alias("across"))
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("Item"), F.col(i).alias("Value")) for i in ("total", "squares", "across")]))
    return one.select(ds_name(t.spec).alias("Dataset"), items.alias("r")).select("Dataset", "r.*")


# ----------------------------------------------------------- Isolation Forest
#: Trees of a forest, and the rows that each is grown on.
TREES, SAMPLE = 100, 256


def _c(n):
    """Average path length of an unsuccessful BST search (Liu et al. 2008)."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.RandomState, max_depth: int) -> list:
    """Isolation tree as a node list: (feature, threshold, left, right, size)."""
    nodes = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (-1, 0.0, -1, -1, len(idx))
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if cand.size == 0:
            nodes[me] = (-1, 0.0, -1, -1, len(idx))
            return me
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        li = build(left, depth + 1)
        ri = build(right, depth + 1)
        nodes[me] = (f, thr, li, ri, len(idx))
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _paths(nodes: list, depth: int) -> tuple:
    """A tree as arrays (features, thresholds, path lengths of the last level) of a full binary tree of ``depth``, children of ``n`` at
    ``2n + 1`` and ``2n + 2``.  Below a leaf every way has its path length."""
    inner = (1 << depth) - 1
    feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
    length = np.zeros(inner + 1)
    stack = [(0, 0, 0)]
    while stack:
        node, place, level = stack.pop()
        f, cut, left, right, size = nodes[node]
        if f < 0:
            first = ((place + 1) << (depth - level)) - 1 - inner
            length[first:first + (1 << (depth - level))] = level + _c([size])[0]
        else:
            feat[place], thr[place] = f, cut
            stack += [(left, 2 * place + 1, level + 1), (right, 2 * place + 2, level + 1)]
    return feat, thr, length


def _path_lengths(x: np.ndarray, paths: tuple, depth: int) -> np.ndarray:
    """Path length of every row of ``x`` through one tree, all rows a level at a time."""
    feat, thr, length = paths
    flat, first = x.ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        right = flat.take(first + feat.take(node)) >= thr.take(node)
        node += node
        node += right
        node += 1
    return length.take(node - ((1 << depth) - 1))


def _first_offer(share: dict, seed: int):
    """The first tree that a row (``ds``, ``h1``, ``h2``) is offered to by the chance ``share[ds]``: a geometric law, so one hash tells."""
    u = (F.shiftrightunsigned(F.xxhash64("h1", "h2", F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0 ** -53)
    first = F.lit(None).cast("long")
    for d, s in share.items():
        first = F.when(F.col("ds") == d, F.floor(F.log(u) / F.lit(math.log1p(-s))) if s < 1 else F.lit(0).cast("long")).otherwise(first)
    return first


def _offered(share: dict, trees: int, seed: int):
    """The trees that a row is offered to, each with the chance ``share[ds]``, independently; none: null.  Trees after the first have a
    hash each."""
    first, chance = _first_offer(share, seed), F.lit(None).cast("double")
    for d, s in share.items():
        chance = F.when(F.col("ds") == d, F.lit(s)).otherwise(chance)
    later = F.filter(F.sequence(first.cast("int"), F.lit(trees - 1)), lambda k: (k == first) | (F.pmod(
        F.xxhash64("h1", "h2", k, F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0 < chance))
    return F.when(first < trees, later)


def forest(t: Tables, x: DataFrame, trees: int, sample: int) -> tuple:
    """({ds: trees as arrays}, {ds: rows a tree was grown on}, depth) of the scaled matrix ``x``.

    Each tree is grown on ``sample`` rows of its dataset drawn by hashes of
    (row key, tree, seed), in its own ``applyInPandas`` group.
    """
    feats, seed = t.matrix_features, t.spec.seed
    # A row is offered to a tree with a chance that gives each tree twice its sample on average; the window keeps ``sample`` of them.
    # One rule at all sizes.
    share = {d: 2.0 * sample / max(1, n) for d, n in t.rows.items()}
    per = _flat(x, feats).where(_first_offer(share, seed) < trees)
    per = per.select("ds", "h1", "h2", *feats, F.explode(_offered(share, trees, seed)).alias("tree")).withColumn("_o", F.xxhash64("h1", "h2", "tree", F.lit(seed)))
    w = Window.partitionBy("ds", "tree").orderBy("_o")
    per = per.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample).drop("_o", "_rn")
    max_depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        d, tr = int(pdf["ds"].iloc[0]), int(pdf["tree"].iloc[0])
        rng = np.random.RandomState(seed * 1000 + tr)
        nodes = _grow(pdf[feats].to_numpy(float), rng, max_depth)
        return pd.DataFrame({"ds": [d], "tree": [tr], "size": [len(pdf)],
                             "nodes": [[list(map(float, nd)) for nd in nodes]]})

    grown = per.groupBy("ds", "tree").applyInPandas(
        grow, "ds int, tree int, size long, nodes array<array<double>>").collect()
    paths, size = {}, {}
    for r in sorted(grown, key=lambda r: (r["ds"], r["tree"])):
        nodes = [tuple(int(v) if i != 1 else v for i, v in enumerate(nd)) for nd in r["nodes"]]
        paths.setdefault(r["ds"], []).append(_paths(nodes, max_depth))
        size.setdefault(r["ds"], r["size"])
    return paths, size, max_depth


def _anomalies(t: Tables, rows: DataFrame, x: DataFrame, trees: int, sample: int, weight: str | None = None) -> DataFrame:
    """``rows`` (kept) with ``score``, the anomaly score by a forest of ``x``, and ``is_outlier`` in place of the features.  Rows are flagged
    above the exact (1 - contamination) quantile of the score, where a row counts ``weight`` times."""
    paths, size, depth = forest(t, x, trees, sample)

    def score(d: int, values: np.ndarray) -> np.ndarray:
        if d not in paths:
            return np.full(len(values), np.nan)
        values, total = np.ascontiguousarray(values), np.zeros(len(values))
        for tree in paths[d]:
            total += _path_lengths(values, tree, depth)
        return 2.0 ** (-(total / len(paths[d])) / _c([size[d]])[0])

    sc = t.hold(_scored(rows, t.matrix_features, "score", score))
    c = t.spec.thresholds.outlier_contamination
    of = sc.select("ds", "score", (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    thr = group_quantiles(of, ["ds"], "score", ["n"], [1 - c], t.spec.rank_buckets)
    thr = thr.select("ds", F.col("quantile").alias("_thr"))  # one row per dataset
    return sc.join(F.broadcast(thr), "ds").withColumn("is_outlier", F.col("score") > F.col("_thr")).drop("_thr")


def isolation_forest_flags(t: Tables, x: DataFrame | None = None, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(ds, h1, h2, score, is_outlier) per row."""
    if x is None:
        x, _ = scaled_matrix(t)
    return _anomalies(t, _flat(x, t.matrix_features), x, trees, sample)


# ----------------------------------------------------------------- summaries
def multivariate_outliers(t: Tables, methods: tuple = ("Isolation Forest", "LOF", "Mahalanobis")) -> DataFrame:
    """O7 (record-level rows): share of rows flagged per method, % of all rows, 2 dp."""
    from .lof import lof_flags

    k = t.spec.thresholds.min_multivariate_rows
    n = t.rows
    v = scaled_vectors(t)

    def counts(flags: DataFrame, method: str) -> DataFrame:
        return flags.groupBy("ds").agg(F.sum(F.when(F.col("is_outlier"), F.col("w")).otherwise(0)).alias("k")).withColumn("Method", F.lit(method))

    parts = []
    if "Isolation Forest" in methods:
        parts.append(counts(_anomalies(t, v, scaled_matrix(t)[0], TREES, SAMPLE, "w"), "Isolation Forest"))
    if "LOF" in methods:
        parts.append(counts(lof_flags(t), "LOF"))
    if "Mahalanobis" in methods:
        parts.append(counts(_distances(t, v), "Mahalanobis"))
    r = reduce(DataFrame.unionByName, parts)
    rows = t.p.d1.sparkSession.createDataFrame([(d, v) for d, v in n.items() if v >= k], "ds int, rows long")
    r = r.join(F.broadcast(rows), "ds")
    return r.select(ds_name(t.spec).alias("Dataset"), F.lit("Multivariate").alias("Analysis_Type"),
                    F.lit("All").alias("Feature_or_Method"), "Method",
                    F.bround(F.col("k") / F.col("rows") * 100, 2).alias("Pct_Outliers"))


def outlier_projection(t: Tables) -> DataFrame:
    """Per-row PCA-2 coordinates with the Mahalanobis, Isolation Forest and LOF flags."""
    from .lof import lof_rows

    x, _ = scaled_matrix(t)
    x = t.hold(x)
    fit = pca_fit(t, x, components=2)
    sc = pca_scores(t, x, fit, 2).select("ds", "id", F.col("_rk.h1").alias("h1"), F.col("_rk.h2").alias("h2"),
                                         "PC1", "PC2")
    mh = mahalanobis_flags(t, x).select("ds", "h1", "h2", F.col("is_outlier").alias("Mahalanobis_Outlier"))
    iso = isolation_forest_flags(t, x).select("ds", "h1", "h2", F.col("is_outlier").alias("IsolationForest_Outlier"))
    lof = lof_rows(t, x).select("ds", "h1", "h2", F.col("is_outlier").alias("LOF_Outlier"))
    j = sc.join(mh, ["ds", "h1", "h2"]).join(iso, ["ds", "h1", "h2"]).join(lof, ["ds", "h1", "h2"], "left")
    return j.select(ds_name(t.spec).alias("Dataset"), "id", "PC1", "PC2", "Mahalanobis_Outlier",
                    "IsolationForest_Outlier", F.coalesce("LOF_Outlier", F.lit(False)).alias("LOF_Outlier"))


def mahalanobis_summary(t: Tables) -> DataFrame:
    """O4 only (rows of the outlier summary)."""
    return multivariate_outliers(t, ("Mahalanobis",))
