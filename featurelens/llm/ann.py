"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees are fitted on the driver from a bounded sample (``SAMPLE`` vectors of smallest id hash): a node is split
at the median of the projections on the difference of two of its vectors, until there are ``LEAVES``
leaves.  Every row is indexed: a task walks its vectors down all trees and sends them to their leaves'
cells, in blocks of at most about ``BLOCK`` rows.  A query searches all trees through one priority queue, by
margin to the nearest hyperplane passed on the wrong side, until the leaves taken hold ``search`` times
the table (leaves of different trees overlap), and is sent to the cells of those leaves.  A cell reranks
its rows exactly, in double precision, and returns each query's best; the best over all cells are the result.

The number of leaves, and so of cells that a query visits, does not depend on the table; what a cell scores
does.  The vectors of the test tables are nearly random in 64 dimensions, where recall of 0.9
takes about half the table; for clustered vectors a smaller ``search`` does.

* Vectors that are null, hold null or non-finite components, are zero, or have another length than most
  take no part, nor do rows without id.  Rows equal in id and vector count once.
* Equal vectors are one point of the index, which keeps the k + 1 smallest ids: ties go to smaller ids,
  so no further id of it can be among the k nearest.
* A query finds all other rows if there are fewer than k.  An empty table gives an empty result.
  Only the two named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, TREES, LEAVES, LEAST_LEAF, BLOCK = 20_000, 12, 64, 8, 16_384
SEARCH = 1.1
SEED = 41
#: What two ways to compute a cosine may differ by.
ROUNDING = 1e-12
PACKET = "cell long, ids binary, vectors binary"
PACKET_ARROW = pa.schema([("cell", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND = "query long, point long, score double"
FOUND_ARROW = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


@dataclass
class Tree:
    """Inner nodes in arrays; a child below 0 is leaf number -1 - child."""

    normal: np.ndarray
    level: np.ndarray
    child: np.ndarray  # node, side
    share: np.ndarray  # of the sample, by leaf


def grow(unit: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
    normal, level, child, share = [], [], [], []

    def leaf(rows: np.ndarray) -> int:
        share.append(len(rows) / len(unit))
        return -len(share)

    def build(rows: np.ndarray, parts: int) -> int:
        if parts < 2 or len(rows) < 2 * LEAST_LEAF:
            return leaf(rows)
        for _ in range(3):
            a, b = unit[rng.choice(rows, 2, replace=False)]
            at = unit[rows] @ (a - b)
            middle = float(np.median(at))
            if at.min() < middle:
                break
        else:
            return leaf(rows)
        k = len(normal)
        normal.append((a - b) / np.linalg.norm(a - b))
        level.append(middle / np.linalg.norm(a - b))
        child.append([0, 0])
        child[k] = [build(rows[at < middle], parts // 2), build(rows[at >= middle], parts // 2)]
        return k

    build(np.arange(len(unit)), leaves)
    size = unit.shape[1]
    return Tree(np.array(normal).reshape(-1, size), np.array(level), np.array(child, int).reshape(-1, 2), np.array(share))


class Forest:
    def __init__(self, vectors: np.ndarray, total: int, trees: int, leaves: int, block: int, seed: int):
        unit = units(vectors)
        rng = np.random.default_rng(seed)
        self.trees = [grow(unit, leaves, rng) for _ in range(trees)]
        #: Blocks that a leaf's rows are dealt to, and the number of a leaf's first cell.
        self.blocks = [np.maximum(1, np.ceil(t.share * total / block).astype(int)) for t in self.trees]
        ends = np.cumsum(np.concatenate([[0], *self.blocks]))
        first, self.first = 0, []
        for b in self.blocks:
            self.first.append(ends[first:first + len(b)])
            first += len(b)

    def leaves(self, unit: np.ndarray, tree: Tree) -> np.ndarray:
        node = np.zeros(len(unit), int) if len(tree.child) else np.full(len(unit), -1)
        while (open_rows := np.flatnonzero(node >= 0)).size:
            at = node[open_rows]
            side = np.einsum("ij,ij->i", unit[open_rows], tree.normal[at]) >= tree.level[at]
            node[open_rows] = tree.child[at, side.astype(int)]
        return -1 - node

    def cells(self, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The cell of each row in each tree."""
        found = []
        for t, tree in enumerate(self.trees):
            leaf = self.leaves(unit, tree)
            found.append(self.first[t][leaf] + ids.astype(np.uint64).astype(object) % self.blocks[t][leaf]
                         if self.blocks[t].max() > 1 else self.first[t][leaf])
        return np.stack(found, axis=1).astype(np.int64)

    def visit(self, unit: np.ndarray, search: float) -> list[int]:
        """Cells of the leaves that the shared queue gives first, until they hold ``search`` of the table."""
        margin = [t.normal @ unit - t.level for t in self.trees]
        queue = [(0.0, t, 0 if len(tree.child) else -1) for t, tree in enumerate(self.trees)]
        cells, held = [], 0.0
        while queue and held < search:
            passed, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while node >= 0:
                m = margin[t][node]
                near = int(m >= 0)
                heapq.heappush(queue, (max(passed, abs(m)), t, int(tree.child[node, 1 - near])))
                node = tree.child[node, near]
            leaf = -1 - node
            held += tree.share[leaf]
            cells += range(self.first[t][leaf], self.first[t][leaf] + self.blocks[t][leaf])
        return cells


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1))[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def packets(cells: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """Rows of (row, cell) pairs, packed by cell."""
    row, cell = cells
    order = np.argsort(cell, kind="stable")
    row, cell = row[order], cell[order]
    edge = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
    out = [{"cell": int(cell[a]), "ids": ids[row[a:b]].tobytes(), "vectors": vectors[row[a:b]].tobytes()}
           for a, b in zip(edge, [*edge[1:], len(cell)][:len(edge)], strict=True)]
    return pa.RecordBatch.from_pylist(out, PACKET_ARROW)


def unpacked(table: pa.Table, kind: np.dtype, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
    return ids, np.frombuffer(b"".join(table["vectors"].to_pylist()), kind).reshape(-1, size)


def best(rows: pa.Table, queries: pa.Table, kind: np.dtype, size: int, k: int) -> pa.Table:
    """Each query's ``k`` nearest rows of a cell, scored in double precision; ties go to smaller ids."""
    if not rows.num_rows or not queries.num_rows:
        return pa.Table.from_pylist([], FOUND_ARROW)
    ids, x = unpacked(rows, kind, size)
    asked, q = unpacked(queries, kind, size)
    x, ux, out = x.astype(np.float64), units(x), []
    norm = np.sqrt((x * x).sum(axis=1))
    for i in range(0, len(q), 256):
        near = units(q[i:i + 256]) @ ux.T
        place = len(ids) - min(k, len(ids))
        for j, last in enumerate(np.partition(near, place, axis=1)[:, place]):
            at = np.flatnonzero(near[j] >= last - ROUNDING)
            v = q[i + j].astype(np.float64)
            exact = (x[at] * v).sum(axis=1) / (norm[at] * np.sqrt((v * v).sum()))
            first = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(first), asked[i + j]), ids[at[first]], exact[first]))
    return pa.table({n: pa.array(np.concatenate([o[c] for o in out])) for c, n in enumerate(FOUND_ARROW.names)})


def points(rows: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """Distinct usable vectors: ``point`` (smallest id), ``ids`` (the k + 1 smallest), ``vector``, ``hash``."""
    valid = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    common = valid.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = common.orderBy(F.desc("n"), "size").limit(1).select("size").scalar()
    valid = valid.where(F.size("vector") == size).withColumn("hash", F.xxhash64("vector"))
    same = Window.partitionBy("hash", "vector").orderBy("id")
    first = valid.dropDuplicates(["id", "hash", "vector"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    return first.groupBy("hash", "vector").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            trees: int = TREES, leaves: int = LEAVES, search: float = SEARCH, sample: int = SAMPLE, block: int = BLOCK,
            seed: int = SEED) -> DataFrame:
    """Of each row where ``is_query`` holds: ``query_id``, ``rank`` (from 1), ``id_col``, ``score``; every row
    but the query's own is a candidate."""
    spark = rows.sparkSession
    kind = np.dtype(np.float32 if rows.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64)
    if kind == np.float64:
        rows = rows.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    index = stored(points(rows, id_col, vector_col, k), "points")
    asked = rows.where(is_query & F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    asked = asked.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector"),
                         F.xxhash64(vector_col).alias("hash")).dropDuplicates(["query_id", "hash", "vector"])
    asked = stored(asked.join(index.select("hash", "vector", "point"), ["hash", "vector"]), "queries")
    total = index.count()
    drawn = matrix(index.orderBy(F.xxhash64("point"), "point").limit(sample).select("vector").toArrow()["vector"].combine_chunks())
    size = drawn.shape[1]
    forest = spark.sparkContext.broadcast(Forest(drawn, total, trees, leaves, block, seed) if len(drawn) else None)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            if len(ids):
                cells = forest.value.cells(units(x), ids)
                yield packets((np.repeat(np.arange(len(ids)), cells.shape[1]), cells.ravel()), ids, x)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            if len(ids):
                visits = [forest.value.visit(u, search) for u in units(x)]
                row = np.repeat(np.arange(len(ids)), [len(v) for v in visits])
                yield packets((row, np.concatenate(visits).astype(np.int64)), ids, x)

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        return best(left, right, kind, size, k + 1)

    cells = index.select("point", "vector").mapInArrow(indexed, PACKET)
    probes = asked.select("point", "vector").dropDuplicates(["point"]).mapInArrow(probing, PACKET)
    found = cells.groupBy("cell").cogroup(probes.groupBy("cell")).applyInArrow(ranked, FOUND)
    # Trees return the same row again: once each, then the best over all cells.
    once = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    once = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    near = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))
    lists = once.join(index.select("point", "ids"), "point").groupBy("query").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(near))), 1, k + 1).alias("near"))
    mine = asked.select("query_id", "point").join(lists, F.col("point") == F.col("query"))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(others).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias(id_col),
                      (-F.col("n.far")).alias("score"))
