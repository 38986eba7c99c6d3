"""Periodic runs of words: maximal repetitions by suffix-tree LCE queries and Lyndon roots.

A run is a stretch of consecutive words with smallest period ``q``, at least ``max(least, 2 q)`` words long, that no
neighbouring word extends.  Every run holds a Lyndon word of length ``q`` that, for one of the two orders of the
alphabet, is the longest Lyndon word from its first place; so two candidates a place suffice.  ``runs`` takes
them from the ranks of the suffixes (the longest Lyndon word ends before the next smaller suffix), extends each to
both sides by longest common extensions and keeps those that span two periods.  Extensions are
lowest common ancestors in two Ukkonen trees, of the words and of their reversal: the least string depth between two
leaves of the Euler tour, found in constant time from block minima.

Trees are grown only over stretches that can hold a run.  With ``w = ceil(least / 2)``, each word of a run is in a
window of ``w`` words that begins again ``q`` words on or back inside the run, so ``stretches`` keeps the
words covered by windows repeated in the same stretch, until nothing changes.  That loses no run: windows are found by 64-bit
hashes, and equal windows have equal hashes; a chance agreement only adds words to a tree.  Words in a tree are
compared by their bytes.

* A null text counts as empty; an empty one has no words, no runs and an empty collapsed text.
* Repeated rows are treated each; a null id is an id like any other.  An empty table gives an empty result.
* Each text is one task's work: a stretch of n words takes some 600 bytes a word while its trees are grown.  Texts
  without repeated windows take numpy passes only.
* Input columns are kept, but those named like a result, which are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, mix, parts, windows, words

#: Shortest run, in words.
LEAST = 12
#: Places of the Euler tour in a block of the range-minimum structure.
BLOCK = 16
U = np.uint64
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (positive integers, with 0 as a unique last one)."""

    def __init__(self, symbols: list[int]):
        self.size, self.symbols = len(symbols), max(symbols) + 1
        n, m, s = self.size, self.symbols, symbols
        start, end, link = array("i", [0]), array("i", [0]), array("i", [0])
        leaf = array("i", [-1])  # the suffix of a leaf, -1 for inner nodes
        edges: dict[int, int] = {}  # node and first symbol -> child
        node = at = length = rest = 0
        for i, symbol in enumerate(s):
            rest += 1
            unlinked = 0
            while rest:
                if not length:
                    at = i
                key = node * m + s[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    leaf.append(i - rest + 1)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    first = start[child]
                    long = end[child] - first
                    if length >= long:
                        node, at, length = child, at + long, length - long
                        continue
                    if s[first + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    edges[key] = split
                    start.extend((first, i))
                    end.extend((first + length, n))
                    link.extend((0, 0))
                    leaf.extend((-1, i - rest + 1))
                    start[child] = first + length
                    edges[split * m + symbol] = split + 1
                    edges[split * m + s[first + length]] = child
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                rest -= 1
                if not node and length:
                    length -= 1
                    at = i - rest + 1
                elif node:
                    node = link[node]
        self.leaf = leaf
        self.length = np.frombuffer(end, np.int32) - np.frombuffer(start, np.int32)
        self.key = np.fromiter(edges.keys(), np.int64, len(edges))
        self.child = np.fromiter(edges.values(), np.int64, len(edges))

    def children(self, falling: bool = False) -> tuple[list[int], list[int]]:
        """Children of all nodes by first symbol (0 first in both orders), and where each node's begin."""
        node, symbol = self.key // self.symbols, self.key % self.symbols
        if falling:
            symbol = np.where(symbol == 0, 0, self.symbols - symbol)
        order = np.lexsort((symbol, node))
        begin = np.searchsorted(node[order], np.arange(len(self.leaf) + 1))
        return self.child[order].tolist(), begin.tolist()

    def ranks(self, falling: bool = False) -> np.ndarray:
        """Rank of each suffix for the rising or falling order of symbols."""
        child, begin = self.children(falling)
        leaf, found, stack = self.leaf, [], [0]
        while stack:
            x = stack.pop()
            if leaf[x] >= 0:
                found.append(leaf[x])
            else:
                stack += child[begin[x]:begin[x + 1]][::-1]
        out = np.empty(self.size, np.int64)
        out[found] = np.arange(self.size)
        return out

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String depths along the Euler tour, the place of each suffix's leaf in it, and the suffixes' ranks."""
        child, begin = self.children()
        length, leaf = self.length.tolist(), self.leaf
        depth, depths, place, found, stack = [0] * len(leaf), [], [0] * self.size, [], [0]
        while stack:
            x = stack.pop()
            if x < 0:  # back from a child
                depths.append(depth[~x])
                continue
            mine = depth[x]
            if leaf[x] >= 0:
                place[leaf[x]] = len(depths)
                found.append(leaf[x])
            else:
                for c in child[begin[x]:begin[x + 1]][::-1]:
                    depth[c] = mine + length[c]
                    stack += (~x, c)
            depths.append(mine)
        ranks = np.empty(self.size, np.int64)
        ranks[found] = np.arange(self.size)
        return np.array(depths, np.int32), np.array(place, np.int64), ranks


class Extension:
    """Longest common extensions: least depth between two places of the tour, by block minima."""

    def __init__(self, depths: np.ndarray, place: np.ndarray):
        self.place, blocks = place, -(-len(depths) // BLOCK)
        self.depths = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.depths[:len(depths)] = depths
        grid = self.depths.reshape(blocks, BLOCK)
        self.upto = np.minimum.accumulate(grid, axis=1).ravel()
        self.since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while len(self.levels[-1]) > (1 << len(self.levels) - 1):
            below, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes ``i`` and ``j`` (never equal)."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.since[a], self.upto[b])
        same = np.flatnonzero(first == last)
        if len(same):
            at = a[same, None] + np.arange(BLOCK)
            at = np.minimum(at, b[same, None])
            out[same] = self.depths[at].min(axis=1)
        span = last - first - 1
        far = np.flatnonzero(span > 0)
        if len(far):
            level = np.log2(span[far]).astype(np.int64)
            for k in np.unique(level):
                some = far[level == k]
                row = self.levels[k]
                out[some] = np.minimum(out[some], np.minimum(row[first[some] + 1], row[last[some] - (1 << k)]))
        return out


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """The next place of smaller rank, of each but the last (which has the smallest)."""
    rank = ranks.tolist()
    found = [0] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        j, mine = i + 1, rank[i]
        while rank[j] > mine:
            j = found[j]
        found[i] = j
    return np.array(found[:-1], np.int64)


def runs(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """All runs of a sequence of positive integers: rows of start, length, period, by start, then period."""
    n = len(symbols)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree([*symbols, 0])
    falling = tree.ranks(falling=True)
    depths, place, rising = tree.tour()
    del tree
    ahead = Extension(depths, place)
    depths, place, _ = SuffixTree([*symbols[::-1], 0]).tour()
    back = Extension(depths, place)
    at = np.tile(np.arange(n), 2)
    period = np.concatenate([next_smaller(rising), next_smaller(falling)]) - at
    start = at - back.common(n - at, n - at - period)
    end = at + period + ahead.common(at, at + period)
    good = (end - start >= 2 * period) & (end - start >= least)
    found = np.stack([start, end - start, period], axis=1)[good]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(w: Words, least: int = LEAST) -> list[tuple[int, int]]:
    """First and last + 1 words (of all texts') of the stretches that can hold a run."""
    k = (least + 1) // 2
    first, hashes = windows(w, k)
    group = w.doc[first].astype(U)
    n = len(w.hash)
    while len(first):
        keys = mix(hashes ^ (group * U(0x9E3779B97F4A7C15)))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        again = np.zeros(len(keys) + 1, bool)
        again[1:-1] = ordered[1:] == ordered[:-1]
        kept = np.sort(order[again[1:] | again[:-1]])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, first[kept], 1)
        np.add.at(edge, first[kept] + k, -1)
        covered = np.cumsum(edge[:-1]) > 0
        fresh = covered.copy()  # where a stretch begins
        fresh[1:] &= ~covered[:-1] | (w.doc[1:] != w.doc[:-1])
        begin = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        size = np.bincount(number[covered], minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
        kept = kept[size[number[first[kept]]] >= least]
        if len(kept) == len(first):
            long = size >= least
            return list(zip(begin[long].tolist(), (begin + size)[long].tolist(), strict=True))
        first, hashes, group = first[kept], hashes[kept], number[first[kept]].astype(U)
    return []


def runs_of(w: Words, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in w.count]
    begin = np.cumsum(w.count) - w.count
    for a, b in stretches(w, least):
        known: dict[bytes, int] = {}
        low, text = int(w.start[a]), w.data[w.start[a]:w.end[b - 1]].tobytes()
        symbols = [known.setdefault(text[s:e], len(known) + 1)
                   for s, e in zip((w.start[a:b] - low).tolist(), (w.end[a:b] - low).tolist(), strict=True)]
        doc = int(w.doc[a])
        shift = a - int(begin[doc])
        found[doc] += [(s + shift, n, p) for s, n, p in runs(symbols, least).tolist()]
    return found


def collapsed(text: bytes, found: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    kept = text.split()  # ASCII white space is 0x20 and 0x09-0x0D
    if found:
        edge = np.zeros(len(kept) + 1, np.int64)
        for start, length, period in found:
            edge[start + period] += 1
            edge[start + length] -= 1
        kept = [kept[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(kept).decode()


def find(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without ``text_col`` and with ``n_words``, ``runs`` (by start, then period) and ``collapsed`` (the text
    with each run cut to its first period)."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)),
           T.StructField("collapsed", T.StringType())]
    names = [f.name for f in new]
    rows = docs.select(*[F.col(c) for c in docs.columns if c != text_col and c not in names],
                       F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *new])
    kind = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]), False))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(pa.Table.from_batches([batch]), "__text"):
                texts = part.column("__text")
                w = words(texts)
                each = runs_of(w, least)
                whole, at = w.data.tobytes(), w.offset.tolist()
                cut = [collapsed(whole[at[i]:at[i + 1]], r) for i, r in enumerate(each)]
                flat = np.array([r for one in each for r in one], np.int64).reshape(-1, 3)
                ends = np.concatenate([[0], np.cumsum([len(one) for one in each])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(w.count), pa.ListArray.from_arrays(pa.array(ends), values, type=kind),
                     pa.array(cut, pa.string())], names=schema.names)

    return rows.mapInArrow(found, schema)
