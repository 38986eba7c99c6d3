"""Exact k nearest neighbours of every point, without all pairs: cells of a kd-tree and bounded visits.

``points`` are distinct vectors with weights (how many rows share one), so copies never fill a cell.

1. A kd-tree fitted on a bounded sample (its planes are all that is broadcast) deals the points to cells of about
   ``CELL`` points.  The sample only balances the cells; the result is exact whatever they are.
2. Each cell looks for neighbours among its own points, which bounds each point's k-th distance from above.
3. A point visits only the other cells whose region is within that bound, with the bound.  A cell with more than ``CELL``
   visitors deals them to blocks, each of which meets the cell's points.  What comes back is not pairs but the cell's points that a visitor
   of a cell may have as neighbours, once for the visiting cell: its halo.
4. Each cell finds the neighbours of its points among these and its halo, all in one task (``found``).

Neighbours are all points up to the k-th distance, ties included (to nine digits), as the definition of k-distance neighbourhoods
has it; a point's other copies are neighbours at distance 0.  Points are numbered by cell and rank of their coordinates in it, a function of
the data alone.  Visits, and with them the work, grow with the dimension: in a few dimensions a small multiple of the points, with
dozens of unrelated features nearly every cell (``visits`` counts them), and a halo may then hold most of the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a cell, sampled points for each cell, and the most cells of one tree.
CELL, SAMPLED, MOST_CELLS = 20_000, 32, 8192
#: Points compared at a time (a leaf), leaves that a search begins with, and rounds of the search that only bounds the distances.
LEAF, FIRST, ROUNDS = 128, 16, 1
#: Squares that short floats do not tell from 0.
LOST = 1e-30
#: Distances that agree to nine digits are equal.
TIE = 1 + 1e-9
EDGE = "ds int, cell int, at int, d double, w long, ocell int, oat int, kd double"
EDGES = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
NAMES = ["ds", "cell", "at", "d", "w", "ocell", "oat", "kd"]


def halved(part: np.ndarray) -> tuple[int, float]:
    """An axis and a plane that leave points on both sides: across the widest axis that can be split into parts of a quarter or more, else
    the axis that splits most evenly.  (The median of a column that one value fills has nothing below it.)"""
    best = (0, 0, np.inf)
    for axis in np.argsort(part.min(axis=0) - part.max(axis=0), kind="stable").tolist():
        values = np.sort(part[:, axis])
        middle = values[len(values) // 2]
        first, beyond = np.searchsorted(values, middle), np.searchsorted(values, middle, side="right")
        for at in (first, beyond):  # the planes on either side of the middle value
            side = min(at, len(values) - at)
            if side > best[0]:
                best = (side, axis, values[at])
        if 4 * best[0] >= len(values):
            break
    return best[1], best[2]


class Cells:
    """A kd-tree's planes: region ``i`` of the last level is cell ``i``; inner node ``n`` has children ``2n + 1`` and ``2n + 2``."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        self.dims = sample.shape[1]
        inner = (1 << self.depth) - 1
        self.axis, self.plane = np.zeros(inner, np.int64), np.full(inner, np.inf)
        parts = {0: sample}
        for node in range(inner):
            part = parts.pop(node)
            left = part
            if len(part):
                self.axis[node], self.plane[node] = halved(part)
                below = part[:, self.axis[node]] < self.plane[node]
                left, part = part[below], part[~below]
            parts[2 * node + 1], parts[2 * node + 2] = left, part[:0] if left is part else part

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] >= self.plane[node])
        return node - ((1 << self.depth) - 1)

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of all cells."""
        low, high = np.full((1, self.dims), -np.inf), np.full((1, self.dims), np.inf)
        for level in range(self.depth):
            n = 1 << level
            nodes = np.arange(n - 1, 2 * n - 1)
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            high[2 * np.arange(n), self.axis[nodes]] = self.plane[nodes]
            low[2 * np.arange(n) + 1, self.axis[nodes]] = self.plane[nodes]
        return low, high


def blocks(x: np.ndarray) -> list[np.ndarray]:
    """Rows of ``x`` in blocks of at most ``LEAF`` that lie close together."""
    stack, out = [np.arange(len(x))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            if len(rows):
                out.append(rows)
            continue
        part = x[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(part[:, axis], half)
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distance of a box to each of several."""
    return np.sqrt((np.maximum(0, np.maximum(lows - high, low - highs)) ** 2).sum(axis=1))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``, row by row, from their differences (no cancellation)."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def kth(row: np.ndarray, d: np.ndarray, w: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of ``n`` rows the distance at which the weights of its candidates reach ``k``; infinite if they do not."""
    order = np.argsort(d)
    order = order[np.argsort(row[order].astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")]  # short integers: by digits
    row, d, total = row[order], d[order], np.cumsum(w[order])
    before = np.concatenate([[0], total])[np.searchsorted(row, np.arange(n))]
    full = np.flatnonzero(total - before[row] >= k)
    out = np.full(n, np.inf)
    rows, first = np.unique(row[full], return_index=True)
    out[rows] = d[full[first]]
    return out


def within(q: np.ndarray, bound: np.ndarray, x: np.ndarray, w: np.ndarray, k: int, own: bool, rounds: int | None = None) -> tuple:
    """Neighbours of the rows of ``q`` among ``x``, up to ``bound`` and to the k-th distance in ``x``: (row of q, row of x,
    distance, weight).  ``own``: ``x`` begins with ``q``; a point is no neighbour of itself, its copies are.  After ``rounds``
    the search ends with what is found so far, and the k-th distances are bounds.

    Matrix products (in short floats, centred at the block that is compared) screen the candidates, with room for all of their rounding;
    only candidates get exact distances, and these decide."""
    leaves = blocks(x)
    lows, highs = np.array([x[i].min(axis=0) for i in leaves]), np.array([x[i].max(axis=0) for i in leaves])
    least = k + 1 if own else k  # so many points weigh at least k: each has a row, but of its own a point counts the others only
    room = 32 * float(np.finfo(np.float32).eps) * (x.shape[1] + 4)  # of the sum of both squares, and of a limit
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    found, reach = [empty], np.full(len(q), np.inf)
    for rows in leaves if q is x else blocks(q):
        exact, most = q[rows], bound[rows].copy()
        middle = exact.mean(axis=0)
        part = np.empty((len(rows), x.shape[1] + 2), np.float32)
        part[:, :-2], part[:, -1] = exact - middle, 1
        square = ((exact - middle) ** 2).sum(axis=1)
        gap = apart(exact.min(axis=0), exact.max(axis=0), lows, highs)
        order = np.argsort(gap, kind="stable")
        near, (who, at, d, weight) = 0, empty
        left, loose = rounds or len(order), np.isinf(most).any()
        while left and near < len(order) and gap[order[near]] <= most.max() * TIE:
            left -= 1
            # the nearest leaves first, twice as many each time, until none left is within reach
            upto = min(len(order), max(FIRST, 2 * near))
            some = np.flatnonzero(gap[order[near]] <= most * TIE)
            new = np.concatenate([leaves[j] for j in order[near:upto] if gap[j] <= most.max() * TIE])
            near = upto
            other = np.empty((len(new), x.shape[1] + 2), np.float32)
            other[:, :-2] = x[new] - middle
            other[:, -1] = norm = (1 - room) * ((x[new] - middle) ** 2).sum(axis=1)
            other[:, :-2] *= -2
            other[:, -2] = 1
            limit = (most[some] * TIE) ** 2
            if loose and len(new) > least:
                part[:, -2] = (1 - room) * square
                about = part[some] @ other.T
                closest = np.partition(about, least - 1, axis=1)[:, least - 1] + 4 * room * (square[some] + norm.max())
                hit = about <= (np.minimum(limit, np.maximum(closest, 0) * TIE ** 2) * (1 + room) + LOST)[:, None]
            elif np.isinf(limit).any():
                hit = np.ones((len(some), len(new)), bool)
            else:
                part[some, -2] = (1 - room) * square[some] - limit * (1 + room) - LOST
                hit = part[some] @ other.T <= 0
            i, j = np.divmod(np.flatnonzero(hit), len(new))
            if not len(i):
                continue
            i, j = some[i], new[j]
            who, at = np.concatenate([who, i]), np.concatenate([at, j])
            d = np.concatenate([d, paired(exact[i], x[j])])
            weight = np.concatenate([weight, w[j] - (j == rows[i]) if own else w[j]])
            most = np.minimum(most, kth(who, d, weight, k, len(rows)))
            keep = d <= most[who] * TIE
            who, at, d, weight = who[keep], at[keep], d[keep], weight[keep]
        real = weight > 0
        found.append((rows[who[real]], at[real], d[real], weight[real]))
        reach[rows] = most
    return (*[np.concatenate(c) for c in zip(*found, strict=True)], reach)


def vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(-1, dims)


def ordered(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Points (a cell's, whole) in the order that numbers them, with their weights."""
    x, w = vectors(table["x"], dims), table["w"].to_numpy()
    order = np.lexsort(x.T[::-1])
    return x[order], w[order]


def fitted(points: DataFrame, dims: int, cell: int) -> dict[int, Cells]:
    """A tree for each dataset, on a sample by hash of at most about ``SAMPLED * MOST_CELLS`` points of it."""
    n = {r["ds"]: r["n"] for r in points.groupBy("ds").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = {d: min(MOST_CELLS, -(-c // cell)) for d, c in n.items()}
    one_in = F.lit(None).cast("long")
    for d, c in n.items():
        one_in = F.when(F.col("ds") == d, F.lit(max(1, c // (SAMPLED * cells[d])))).otherwise(one_in)
    taken = points.where(F.pmod(F.xxhash64("x"), one_in) == 0).select("ds", "x").toArrow()
    of, x = taken["ds"].to_numpy(), vectors(taken["x"], dims)
    return {d: Cells(x[of == d], c) for d, c in cells.items()}


def halos(points: DataFrame, dims: int, k: int, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``points``: ``ds``, ``x`` (array of ``dims`` doubles, distinct in ``ds``), ``w`` (rows).  ``points`` must be a stored table: it is
    read several times.

    Returns (home, halo, visits): the points as ``ds, cell, at, x, w`` with ``reach``, a bound of their k-th distance; for each cell the
    points of others (``ds, cell, ocell, oat, x, w``; some twice) that may be among its points' neighbours; the visits as ``ds, cell, vcell``.
    """
    from .store import written

    trees = fitted(points, dims, cell)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds, x = b.column(0).to_numpy(), vectors(pa.chunked_array([b.column(1)]), dims)
            at = np.zeros(len(ds), np.int32)
            for d, tree in trees.items():
                at[ds == d] = tree.of(x[ds == d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["ds", "x", "w", "cell"])

    placed = points.select(F.col("ds").cast("int").alias("ds"), "x", F.col("w").cast("long").alias("w")).mapInArrow(
        dealt, "ds int, x array<double>, w long, cell int")

    def at_home(key: tuple, table: pa.Table) -> pa.Table:
        d, c = (v.as_py() for v in key)
        x, w = ordered(table, dims)
        reach = within(x, np.full(len(x), np.inf), x, w, k, True, ROUNDS)[-1]
        low, high = trees[d].regions()
        rows, cells = visited(x, reach, low, high, c)
        return pa.table([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(np.full(len(x), d, np.int32)),
                         pa.array(np.full(len(x), c, np.int32)), whole(x), pa.array(w), pa.array(reach),
                         listed(rows, cells.astype(np.int32), len(x))], names=["at", "ds", "cell", "x", "w", "reach", "visits"])

    home = written(placed.groupBy("ds", "cell").applyInArrow(
        at_home, "at int, ds int, cell int, x array<double>, w long, reach double, visits array<int>"), "points")
    visits = home.select("ds", "cell", "at", "x", "reach", F.explode("visits").alias("vcell"))
    # blocks of a cell's visitors: a table of cells
    load = visits.groupBy("ds", "vcell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("parts"))
    asked = visits.join(F.broadcast(load), ["ds", "vcell"]).withColumn(
        "part", F.pmod(F.xxhash64("cell", "at"), F.col("parts")).cast("int"))
    hosts = home.select("ds", F.col("cell").alias("vcell"), F.col("at").alias("oat"), "x", "w").join(
        F.broadcast(load), ["ds", "vcell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def abroad(key: tuple, guests: pa.Table, hosts: pa.Table) -> pa.Table:
        x, w, oat = vectors(hosts["x"], dims), hosts["w"].to_numpy(), hosts["oat"].to_numpy()
        asking, other = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if guests.num_rows and hosts.num_rows:
            who, other, *_ = within(vectors(guests["x"], dims), guests["reach"].to_numpy(), x, w, k, False)
            asking, other = np.divmod(np.unique(guests["cell"].to_numpy()[who].astype(np.int64) * len(x) + other), len(x))
        return pa.table([pa.array(np.full(len(other), key[0].as_py(), np.int32)), pa.array(asking.astype(np.int32)),
                         pa.array(np.full(len(other), key[1].as_py(), np.int32)), pa.array(oat[other]), whole(x[other]),
                         pa.array(w[other])], names=["ds", "cell", "ocell", "oat", "x", "w"])

    halo = written(asked.select("ds", "vcell", "part", "cell", "at", "x", "reach").groupBy("ds", "vcell", "part").cogroup(
        hosts.select(*[F.col(c).alias(c) for c in ("ds", "vcell", "part", "oat", "x", "w")]).groupBy("ds", "vcell", "part")
    ).applyInArrow(abroad, "ds int, cell int, ocell int, oat int, x array<double>, w long"), "halo")
    return home.select("ds", "cell", "at", "x", "w", "reach"), halo, visits.select("ds", "cell", "vcell")


def numbered(halo: pa.Table, *columns: str) -> tuple[np.ndarray, np.ndarray, list]:
    """The points of a cell's halo, each once, by cell and number in it: their cells, numbers and other ``columns``."""
    cells, at = halo["ocell"].to_numpy(), halo["oat"].to_numpy()
    _, first = np.unique((cells.astype(np.int64) << 32) + at, return_index=True)
    return cells[first], at[first], [halo.column(c).take(pa.array(first)) for c in columns]


def found(own: pa.Table, halo: pa.Table, dims: int, k: int) -> tuple:
    """Neighbours of a cell's points (row, neighbour, distance, weight, by row and neighbour), the points' k-th distances, their weights, and
    the points by number, with the cells and numbers of those of the halo, which follow the cell's own."""
    own = own.sort_by("at")
    cells, at, (beyond, weights) = numbered(halo, "x", "w")
    q, w = vectors(own["x"], dims), own["w"].to_numpy()
    x = np.concatenate([q, vectors(beyond, dims)]) if len(at) else q
    who, to, d, weight, kd = within(q, own["reach"].to_numpy(), x, np.concatenate([w, weights.to_numpy()]), k, True)
    order = np.lexsort((to, who))
    return who[order], to[order], d[order], weight[order], kd, w, cells, at


def neighbours(points: DataFrame, dims: int, k: int, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the points of ``halos``: (numbered, edges, visits): the points as ``ds, cell, at, x, w``; their neighbours as ``ds, cell, at``
    (point), ``ocell, oat`` (neighbour), ``d``, ``w`` (the neighbour's rows) and ``kd`` (the point's k-th distance); the visits."""
    home, halo, visits = halos(points, dims, k, cell)

    def edges(key: tuple, own: pa.Table, beyond: pa.Table) -> pa.Table:
        c, n = key[1].as_py(), own.num_rows
        who, to, d, weight, kd, _, cells, at = found(own, beyond, dims, k)
        cells, at = np.concatenate([np.full(n, c), cells]), np.concatenate([np.arange(n), at])
        columns = (np.full(len(who), key[0].as_py()), np.full(len(who), c), who, d, weight, cells[to], at[to], kd[who])
        return pa.table([pa.array(v).cast(kind) for v, kind in zip(columns, EDGES, strict=True)], names=NAMES)

    by = ("ds", "cell")
    return home.drop("reach"), home.groupBy(*by).cogroup(halo.groupBy(*by)).applyInArrow(edges, EDGE).where(F.col("kd") < np.inf), visits


def visited(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the other cells that they must visit, by row."""
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block in blocks(x):
        part, far = x[block], reach[block] * TIE
        some = np.flatnonzero(apart(part.min(axis=0), part.max(axis=0), low, high) <= far.max())
        for c in some[some != home]:
            gap = np.sqrt((np.maximum(0, np.maximum(low[c] - part, part - high[c])) ** 2).sum(axis=1))
            hit = block[gap <= far]
            rows.append(hit)
            cells.append(np.full(len(hit), c))
    rows, cells = np.concatenate(rows), np.concatenate(cells)
    order = np.lexsort((cells, rows))
    return rows[order], cells[order]


def offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))


def listed(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values by row (ascending) as lists of ``n`` rows."""
    return pa.ListArray.from_arrays(offsets(rows, n), pa.array(values))


def whole(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
