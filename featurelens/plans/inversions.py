"""Kendall's counts for many column pairs, exactly: inversions inside bounded buckets and between them.

Each column has at most ``2 B + 1`` buckets: ``B`` bounds from a bounded sample, each a bucket of its own value, and the open intervals between
them.  A value that many rows share is a bound, so it fills no interval; and rows of one value hold no discordant pair.

For columns ``i`` and ``j`` (rows with both) a discordant pair of rows lies
* in different buckets of both columns: counted from the contingency table of buckets by cumulative sums;
* in one bucket of ``i`` and two of ``j``: counted where the rows of that bucket of ``i`` meet;
* in one bucket of ``j``: counted where the rows of that bucket of ``j`` meet.
So each row goes once to its interval of each column, with the values of the other columns (``PARTNERS`` at a time), packed: no self-join,
and no intermediate beyond two values for each row and wanted pair.  A task holds one interval, about ``ROWS`` rows.
Ties come from the same tables: equal values share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an interval, sampled rows for each bound, most bounds of a column (a table of buckets has (2 B + 1)^2 counts), and
#: partner columns that travel together.
ROWS, SAMPLED, MOST_BOUNDS, PARTNERS = 100_000, 32, 1024, 16
#: Counts that a task gathers before it sends them.
DENSE = 1 << 21
FOUND = "ds int, i int, j int, disc double, ti double, tj double, tij double"


def bucket(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 k for values between bounds k - 1 and k, 2 k + 1 for bound k; -1 for missing ones."""
    left = np.searchsorted(bounds, x, "left")
    on = left < np.searchsorted(bounds, x, "right")
    return np.where(np.isnan(x), -1, 2 * left + on)


def inversions(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x rising and y falling, both strictly, by the bits of y's rank from the highest."""
    if len(x) < 2:
        return 0
    rank = np.unique(y, return_inverse=True)[1][np.lexsort((y, x))]
    total, group = 0, np.zeros(len(rank), np.int64)  # where each row's block of equal higher bits begins
    for k in range(int(rank.max()).bit_length() - 1, -1, -1):
        one = rank >> k & 1
        before = np.cumsum(one) - one
        inside = before - before[group]  # ones before, in the block
        total += int(inside[one == 0].sum())
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        starts = np.concatenate([[0], ends[:-1]])
        ones = np.add.reduceat(one, starts)
        zeros = (ends - starts) - ones
        at = np.arange(len(rank)) - group
        block = np.repeat(np.arange(len(starts)), ends - starts)
        place = np.where(one == 1, group + zeros[block] + inside, group + at - inside)
        moved, fresh = np.empty_like(rank), np.empty_like(group)
        moved[place] = rank
        fresh[place] = np.where(one == 1, group + zeros[block], group)
        rank, group = moved, fresh
    return total


def tied(*columns: np.ndarray) -> int:
    """Pairs of rows equal in all columns."""
    if not len(columns[0]):
        return 0
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    count = np.bincount(np.cumsum(new)).astype(object if len(order) > 3_000_000_000 else np.int64)
    return int((count * (count - 1) // 2).sum())


def across(table: np.ndarray) -> float:
    """Discordant pairs between different buckets of both columns."""
    later = np.cumsum(table[::-1], axis=0)[::-1] - table  # in later buckets of i
    below = np.cumsum(later, axis=1) - later  # and earlier ones of j
    return float((table * below).sum())


def sampled(wide: DataFrame, cols: list, wanted: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """Bounds of each dataset's columns: ``wanted`` quantiles of a sample by hash of about ``SAMPLED`` rows a bound."""
    out = {d: [np.zeros(0)] * len(cols) for d in wanted}
    if not any(wanted.values()):
        return out
    n = {r["ds"]: r["count"] for r in wide.groupBy("ds").count().collect()}
    one_in = F.lit(None).cast("long")
    for d, b in wanted.items():
        one_in = F.when(F.col("ds") == d, F.lit(max(1, n.get(d, 0) // (SAMPLED * max(1, b))))).otherwise(one_in)
    taken = wide.where(F.pmod(F.xxhash64(*cols, "_rk"), one_in) == 0).select("ds", *cols).toArrow()
    ds = taken["ds"].to_numpy()
    for d, b in wanted.items():
        for k, c in enumerate(cols):
            values = np.sort(taken[c].to_numpy().astype(float)[ds == d])
            values = values[~np.isnan(values)]
            if b and len(values):
                out[d][k] = np.unique(values[(np.arange(1, b + 1) * len(values) // (b + 1)).clip(0, len(values) - 1)])
    return out


def pair_counts(wide: DataFrame, cols: list, pairs: list, rows: int = ROWS) -> DataFrame:
    """``wide``: ``ds`` (1 or 2), ``_rk`` and double ``cols``.  For each wanted pair of column numbers i <= j: (ds, i, j, n, disc, ti, tj,
    tij), over the rows with both: their number, discordant pairs, and pairs tied in i, in j and in both."""
    p = len(cols)
    n = {r["ds"]: r["count"] for r in wide.groupBy("ds").count().collect()}
    bounds = sampled(wide, cols, {d: min(MOST_BOUNDS, -(-c // rows) - 1) for d, c in n.items()})
    width = {d: max(2 * len(b) + 1 for b in of) for d, of in bounds.items()}
    partners: dict[int, set] = {}
    for i, j in pairs:
        partners.setdefault(i, set()).add(j)
        partners.setdefault(j, set()).add(i)
    chunks = {c: [sorted(s)[k:k + PARTNERS] for k in range(0, len(s), PARTNERS)] for c, s in partners.items()}

    def split(batches: Iterator[pa.RecordBatch], of_rows: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            ds = batch.column(0).to_numpy()
            x = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(p)], axis=1).astype(float)
            for d in np.unique(ds).tolist():
                mine = x[ds == d]
                yield d, mine, np.stack([bucket(mine[:, k], bounds[d][k]) for k in range(p)], axis=1)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by pair and pair of buckets."""
        names = ["ds", "i", "j", "cell", "n"]

        def sent(d, i, j, counts):
            at = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)) for v in (d, i, j)]
                                              + [pa.array(at.astype(np.int64)), pa.array(counts[at].astype(np.int64))], names=names)

        held: dict[tuple, np.ndarray] = {}
        dense = sum(w * w for w in width.values()) * len(pairs) <= DENSE
        for d, _, b in split(batches, False):
            for i, j in pairs:
                both = (b[:, i] >= 0) & (b[:, j] >= 0)
                cell = b[both, i] * width[d] + b[both, j]
                if dense:
                    counts = np.bincount(cell, minlength=width[d] ** 2)
                    held[d, i, j] = held[d, i, j] + counts if (d, i, j) in held else counts
                else:
                    at, m = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)) for v in (d, i, j)]
                                                     + [pa.array(at.astype(np.int64)), pa.array(m.astype(np.int64))], names=names)
        for (d, i, j), counts in held.items():
            yield sent(d, i, j, counts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by column and interval: its values and those of partner columns."""
        for d, x, b in split(batches, True):
            out = []
            for c, of in chunks.items():
                inside = np.flatnonzero((b[:, c] >= 0) & (b[:, c] % 2 == 0))
                order = inside[np.argsort(b[inside, c], kind="stable")]
                where = b[order, c]
                edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(order) else []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    for k, js in enumerate(of):
                        out.append((d, c, int(where[s]), k, x[order[s:e]][:, [c, *js]].tobytes()))
            for at in range(0, len(out), 1000):
                some = list(zip(*out[at:at + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in some[:4]] + [pa.array(some[4], pa.binary())],
                                                 names=["ds", "c", "b", "k", "block"])

    want = set(pairs)

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        d, c, _, k = (v.as_py() for v in key)
        js = chunks[c][k]
        x = np.frombuffer(b"".join(v.as_py() for v in table["block"]), float).reshape(-1, 1 + len(js))
        out = []
        for at, j in enumerate(js):
            some = x[~np.isnan(x[:, 1 + at])]
            a, y = some[:, 0], some[:, 1 + at]
            place = bucket(y, bounds[d][j])
            if (c, j) in want:
                disc = 0
                if c != j and len(place) and (place != place[0]).any():  # one bucket of c, different ones of j
                    disc = inversions(a, y) - sum(inversions(a[place == v], y[place == v]) for v in np.unique(place) if v % 2 == 0)
                out.append((d, c, j, disc, tied(a), 0 if c != j else tied(a), tied(a, y)))
            if (j, c) in want and c != j:
                on = place % 2 == 1
                out.append((d, j, c, inversions(y, a), 0, tied(a), tied(a[on], y[on])))
        cols_ = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table([pa.array(v, pa.int32()) for v in cols_[:3]] + [pa.array([float(z) for z in v], pa.float64()) for v in cols_[3:]],
                        names=["ds", "i", "j", "disc", "ti", "tj", "tij"])

    def between(key: tuple, table: pa.Table) -> pa.Table:
        d, i, j = (v.as_py() for v in key)
        w = width[d]
        counts = np.zeros(w * w)
        counts[table["cell"].to_numpy()] = table["n"].to_numpy()
        counts = counts.reshape(w, w)

        def alone(m):  # pairs inside the buckets of one value
            m = m[1::2]
            return float((m * (m - 1) / 2).sum())

        both = counts[1::2, 1::2]
        return pa.table({"ds": pa.array([d], pa.int32()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                         "n": [float(counts.sum())], "disc": [across(counts) if i != j else 0.0], "ti": [alone(counts.sum(axis=1))],
                         "tj": [alone(counts.sum(axis=0))], "tij": [float((both * (both - 1) / 2).sum())]})

    values = wide.select(F.col("ds").cast("int").alias("ds"), *[F.col(c).cast("double").alias(c) for c in cols])
    cells = values.mapInArrow(tables, "ds int, i int, j int, cell long, n long").groupBy("ds", "i", "j", "cell").agg(
        F.sum("n").alias("n"))
    outer = cells.groupBy("ds", "i", "j").applyInArrow(between, FOUND.replace("disc", "n double, disc"))
    blocks = values.mapInArrow(packed, "ds int, c int, b int, k int, block binary")
    inner = blocks.groupBy("ds", "c", "b", "k").applyInArrow(inside, FOUND)
    both = outer.unionByName(inner.withColumn("n", F.lit(0.0)))
    return both.groupBy("ds", "i", "j").agg(*[F.sum(v).alias(v) for v in ("n", "disc", "ti", "tj", "tij")])
