"""Moment (Gram) pass: per-dataset p x p sums in one scan.

Each partition turns its Arrow batches into numpy blocks and accumulates
X'X-type partial sums; only p^2 numbers per partition leave the task, and a
``groupBy(ds, i, j).sum`` adds them.  With ``pairwise=True`` the sums are
pairwise complete (rows where both columns are present), which is what
``DataFrame.corr`` does with missing values.  Values are shifted by a
per-column constant first (typically the mean) so the one-pass formulas do
not cancel catastrophically.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM_SCHEMA = "ds int, i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def gram(df: DataFrame, cols: list, shift: dict | None = None, pairwise: bool = True, weight: str | None = None) -> DataFrame:
    """``df`` has an int ``ds`` column and double ``cols``.

    Returns (ds, i, j, n, sx, sy, sxx, syy, sxy) for i <= j, where sums run over
    rows with both column i and j present (all rows when ``pairwise`` is false
    and there are no nulls); x is column i and y column j, both shifted by
    ``shift[ds][col]``.  A row counts as many times as its column ``weight`` says.
    """
    p = len(cols)
    shifts = {d: np.array([float((shift or {}).get(d, {}).get(c, 0.0) or 0.0) for c in cols]) for d in (1, 2)}
    iu, ju = np.triu_indices(p)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {}
        for batch in batches:
            ds = batch.column(0).to_numpy()
            values = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(p)], axis=1)
            for d in np.unique(ds).tolist():
                x = values[ds == d] - shifts.get(d, np.zeros(p))
                m = ~np.isnan(x)
                x0 = np.where(m, x, 0.0)
                mf = m.astype(float)
                if weight:
                    w = batch.column(1 + p).to_numpy()[ds == d][:, None]
                    a = acc.setdefault(d, [np.zeros((p, p)) for _ in range(4)])
                    for total, (left, right) in zip(a, ((mf, mf), (x0, mf), (x0 * x0, mf), (x0, x0)), strict=True):
                        total += (left * w).T @ right
                    continue
                a = acc.setdefault(d, [np.zeros((p, p)) for _ in range(4)])
                a[0] += mf.T @ mf          # n_ij
                a[1] += x0.T @ mf          # sum x_i over rows with j present
                a[2] += (x0 * x0).T @ mf   # sum x_i^2 over rows with j present
                a[3] += x0.T @ x0          # sum x_i x_j
        for d, (n, sx, sxx, sxy) in acc.items():
            yield pa.RecordBatch.from_pydict({
                "ds": np.full(len(iu), d, np.int32), "i": iu.astype(np.int32), "j": ju.astype(np.int32), "n": n[iu, ju], "sx": sx[iu, ju],
                "sy": sx.T[iu, ju], "sxx": sxx[iu, ju], "syy": sxx.T[iu, ju], "sxy": sxy[iu, ju]})

    src = df.select(F.col("ds").cast("int"), *[F.col(c).cast("double") for c in cols], *([F.col(weight).cast("double")] if weight else []))
    parts = src.mapInArrow(part, GRAM_SCHEMA)
    return parts.groupBy("ds", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def pearson_from_gram(g: DataFrame) -> DataFrame:
    """(ds, i, j, n, r): pairwise-complete Pearson r; NULL for a constant side or n < 2."""
    n = F.col("n")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r = F.when((n >= 2) & (vx > 0) & (vy > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(vx * vy))))
    return g.select("ds", "i", "j", "n", r.alias("r"))


def gram_matrix(rows, p: int, field: str = "sxy") -> dict:
    """Collected (small) Gram rows -> {ds: symmetric numpy p x p of ``field``}."""
    out = {}
    for r in rows:
        m = out.setdefault(r["ds"], np.zeros((p, p)))
        m[r["i"], r["j"]] = r[field]
        m[r["j"], r["i"]] = r[field]
    return out
