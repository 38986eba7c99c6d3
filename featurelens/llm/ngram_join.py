"""N-gram Jaccard join: grouped prefix join, its links, and the components that they make.

A document's set has its distinct shingles of ``SHINGLE`` words (A-Z lower-cased); two documents link
when 100 * intersection >= ``PERCENT`` * union.  All steps are exact (sets are of 64-bit hashes):

1. Shingles are ordered by the number of documents that hold them (``shared_hashes``), rarest first.
   Linked sets of n shingles share one of their first n - ceil(0.85 n) + 1.  Shingles that one document
   alone holds match nothing, so a document whose prefix has only such is done.
2. Documents with equal sets are one node; nodes with the same prefix and size are one group, and groups
   alone are indexed by prefix shingle.
3. Pairs of groups that share a prefix shingle are filtered by size, by the number of shared shingles, by the
   shingle's place in both prefixes and by the counts of shingles by hash class (each the highest among the members).
   The pairs left are expanded to their members, which pass the class bound again, each by its own counts, and are
   verified on their whole sets.

A component needs no more links than connect it, so ``near_duplicates`` takes two rounds: first each group
with a hub under each of its prefix shingles and within its group: the node whose shingles most documents
hold on average, which in a cluster of near copies is its centre; then steps 2 and 3 between the components
found, with groups divided by component.  The second round is exhaustive: a pair is skipped only if a bound rules
the link out, or if its documents are in one component already.  A large group of near copies thus costs a
verification each, and copies of a text are never compared.

``link_counts`` has every link: steps 2 and 3 over all groups, within groups too, and so work as large as its
result where thousands of different near copies all link.

* Nulls: a null text has no words; a null id takes part as a text but is not reported as anyone's
  component, unless all ids of the component are null.
* Without words the set is empty and linked with nothing; with fewer than ``SHINGLE`` words the whole
  sequence is the one shingle.
* Repeated rows are copies and keep their rows.  An empty table gives an empty result.  Texts are
  read whole; only the two named columns are read.
* ``keep_one`` decides by row, not by id: one row of each component stays, also where components share
  their smallest id or have none, and every row without words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared_hashes as sh
from .common import WORD, or_empty, shuffle_partitions, stored
from .components import components
from .words import U, mix, parts, sequences, windows, words

SHINGLE, PERCENT = 4, 85
#: Shingles are counted by so many classes of their hash, for a bound of what two sets can share.
CLASSES = 32
ROWS = "id long, key binary, n long, node binary, grp_key binary, shared long, prefix array<long>, body array<long>, classes array<int>, score long"
LONGS = pa.list_(pa.int64())
ROWS_ARROW = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("node", pa.binary()), ("grp_key", pa.binary()),
                        ("shared", pa.int64()), ("prefix", LONGS), ("body", LONGS), ("classes", pa.list_(pa.int32())), ("score", pa.int64())])
OTHER = U(0x5851F42D4C957F2D)


def shingles(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the rows they are in, by row."""
    w = words(batch.column("text"), fold=True)
    begin = np.concatenate(([0], np.cumsum(w.count)))[:-1]
    first, h = windows(w, k)
    row = w.doc[first]
    for m in range(1, k):
        short = np.flatnonzero(w.count == m)
        if len(short):
            h = np.concatenate((h, mix(sequences(w, begin[short], m) + U(m))))
            row = np.concatenate((row, short))
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


def sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, each once a row, ascending."""
    h, row = shingles(batch, k)
    edge = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        h[a:b].sort()
    once = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
    return h[once], row[once]


def running(values: np.ndarray, kind: type) -> np.ndarray:
    return np.concatenate((np.zeros(1, kind), np.cumsum(values, dtype=kind)))


def described(docs: pa.Table, shared: pa.Table, buckets: int, k: int, percent: int) -> pa.Table:
    """A row per document: size, node (128 bits of its set), and for those whose prefix has shingles
    of other documents these (``prefix``, rarest first) and all such shingles (``body``).  Of equal sets in
    one group of documents the first alone has them.  ``key`` is passed on if the documents have it."""
    known, levels = sh.answered(shared)
    out, met = [], set()
    for batch in parts(docs, "text"):
        h, row = sets(batch, k)
        level = sh.look_up(sh.cut(h, buckets), known, levels)
        edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
        one, two = running(mix(h), U), running(mix(h ^ OTHER), U)
        ids = np.stack((one[edge[1:]] - one[edge[:-1]], two[edge[1:]] - two[edge[:-1]]), axis=1)
        alone = running(level == 0, np.int64)
        alone = (alone[edge[1:]] - alone[edge[:-1]]).tolist()
        edge = edge.tolist()
        keys = batch.column("key").to_pylist() if "key" in batch.schema.names else [None] * batch.num_rows
        for d, (doc_id, key) in enumerate(zip(batch.column("id").to_pylist(), keys, strict=True)):
            a, b = edge[d], edge[d + 1]
            n = b - a
            r = {"id": doc_id, "key": key, "n": n, "shared": n - alone[d]}
            if n:
                r["node"] = node = ids[d].tobytes()
                length = n - -(-percent * n // 100) + 1
                if length > alone[d] and node not in met:
                    met.add(node)
                    mine, at = h[a:b].view(np.int64), level[a:b]
                    r["prefix"] = mine[np.argsort(at, kind="stable")[alone[d]:length]]
                    r["body"] = mine[at > 0]
                    r["score"] = int(at.astype(np.int64).sum() * 1000 // n)
                    r["classes"] = np.bincount(r["body"] & (CLASSES - 1), minlength=CLASSES)
                    r["grp_key"] = hashlib.blake2b(n.to_bytes(8) + r["prefix"].tobytes(), digest_size=16).digest()
            out.append(r)
    return pa.Table.from_pylist(out, ROWS_ARROW)


def enough(common: Column, n: Column, m: Column, percent: int) -> Column:
    return common * (100 + percent) >= (n + m) * percent


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that link."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("__n"), F.col("body").alias("__x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("__m"), F.col("body").alias("__y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("__x", "__y"))
    return both.where(enough(common, F.col("__n"), F.col("__m"), percent)).select("a", "b")


def possible(percent: int, first: bool = False) -> Column:
    """Whether two entries of a shingle, ``x`` and ``y``, can link: by size, shared shingles, and the
    shingle's place.  ``first``: it is the first that both prefixes hold."""
    x, y = ({c: F.col(f"{s}.{c}") for c in ("n", "shared", "at")} for s in "xy")
    before = F.lit(0) if first else F.least(x["at"], y["at"])
    most = before + 1 + F.least(x["shared"] - x["at"] - 1, y["shared"] - y["at"] - 1)
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    return sizes & enough(most, x["n"], y["n"], percent)


def by_class(x: str, y: str) -> Column:
    """What two sets can share at most, by their counts in each class."""
    return sum(F.least(F.col(x)[i], F.col(y)[i]) for i in range(CLASSES))


def grouped_pairs(nodes: DataFrame, percent: int, within: bool) -> DataFrame:
    """Pairs (``a``, ``b``) of ``nodes`` to verify, by groups of ``grp_key`` and ``part``: those of different parts, or,
    ``within``, all pairs (``part`` is then the same function of ``grp_key`` for all)."""
    most = [F.max(F.col("classes")[i]) for i in range(CLASSES)]
    groups = nodes.groupBy("grp_key", "part").agg(
        F.first("n").alias("n"), F.max("shared").alias("shared"), F.first("prefix").alias("prefix"), F.array(*most).alias("classes"))
    groups = stored(groups, "groups")
    opened = groups.select("grp_key", "part", "n", "shared", "classes", F.posexplode("prefix").alias("at", "shingle"))
    if not within:
        held = groups.select(F.explode("prefix").alias("shingle"), "part").groupBy("shingle").agg(
            F.min("part").alias("__low"), F.max("part").alias("__high"))
        opened = opened.join(held.where("__low != __high").select("shingle"), "shingle")
    opened = stored(opened, "open")
    x, y = opened.alias("x"), opened.alias("y")
    ordered = F.col("x.part") <= F.col("y.part") if within else F.col("x.part") < F.col("y.part")
    # A pair that links does so under the first shingle that both prefixes hold; nothing before it is common.
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & ordered & possible(percent, first=True)
                 & enough(by_class("x.classes", "y.classes"), F.col("x.n"), F.col("y.n"), percent))
    met = met.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("grp_key", "part"))).distinct()
    left, right = (nodes.select(F.col("grp_key").alias(f"grp_key_{s}"), F.col("part").alias(f"part_{s}"), F.col("node").alias(name),
                                F.col("n").alias(f"n_{s}"), F.col("classes").alias(f"classes_{s}")) for s, name in (("x", "a"), ("y", "b")))
    same = (F.col("r.grp_key_y") == F.col("l.grp_key_y")) & (F.col("r.part_y") == F.col("l.part_y"))
    once = (F.col("l.grp_key_x") != F.col("l.grp_key_y")) | (F.col("l.part_x") != F.col("l.part_y")) | (F.col("a") < F.col("b"))
    both = met.join(left, ["grp_key_x", "part_x"]).alias("l").join(
        right.alias("r"), same & once & enough(by_class("classes_x", "classes_y"), F.col("n_x"), F.col("n_y"), percent))
    return both.select("a", "b")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row of each set whose prefix has shingles of other documents."""
    return stored(rows.where("prefix is not null").drop("id", "key").dropDuplicates(["node"]), "nodes")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between nodes that connect the components of the whole join."""
    nodes = nodes_of(rows)
    members = nodes.select("node", "grp_key")
    groups = nodes.groupBy("grp_key").agg(
        F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix"),
        F.max("score").alias("score"), F.max_by("node", F.struct("score", "node")).alias("hub"))
    entries = stored(groups.select("grp_key", "n", "shared", "score", "hub", F.posexplode("prefix").alias("at", "shingle")),
                     "entries")
    # First round: each member with the hub of its group, and with the highest hub under each shingle.
    heads = entries.groupBy("shingle").agg(F.max(F.struct("score", "grp_key", "hub", "n", "shared", "at")).alias("h"))
    heads = heads.select("shingle", "h.*")
    star = entries.alias("x").join(heads.alias("y"), "shingle").where(
        (F.col("x.grp_key") != F.col("y.grp_key")) & possible(percent))
    star = star.select(F.col("x.grp_key").alias("grp_key"), F.col("y.hub").alias("b")).unionByName(
        groups.select("grp_key", F.col("hub").alias("b"))).distinct()
    first = star.join(members.select(F.col("node").alias("a"), "grp_key"), "grp_key").where("a != b").select("a", "b")
    first = stored(verified(first, nodes, percent), "links")
    # Second round: what lies between the components found.
    found = components(first)
    parted = nodes.drop("body", "score").join(found, "node", "left").withColumn("part", F.coalesce("comp", "node")).drop("comp")
    second = verified(grouped_pairs(parted, percent, within=False), nodes, percent)
    return found.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(second)


def sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, *key: Column) -> DataFrame:
    """A row per document (``ROWS``)."""
    buckets = shuffle_partitions(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias(id_col), text_col, *(c.alias("key") for c in key))
    texts = sh.grouped(given, id_col, text_col, *("key" for _ in key))
    shared = sh.count(texts, lambda batch: shingles(batch, k))

    def rows_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return described(left, right, buckets, k, percent)

    return stored(texts.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(rows_of, ROWS), "sets")


def named(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node`` and ``comp`` of the rows with words, ``found`` having those that are linked; and of each ``comp`` its smallest
    id, nulls last, with the smallest ``key`` (of the text) that it has there (``least``)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    copies = rows.where("n > 0").groupBy("node").agg(first)
    comps = copies.join(found, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    return comps.select("node", "comp"), comps.groupBy("comp").agg(F.min("least").alias("least"))


def classed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``n``, ``node`` and ``component_id`` of each row."""
    comps, least = named(rows, found)
    names = comps.join(least, "comp").select("node", F.col("least.id").alias("__least"))
    return rows.select("id", "n", "node").join(names, "node", "left").withColumn("component_id", F.coalesce("__least", "id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    rows = sets_of(docs, id_col, text_col, k, percent)
    out = classed(rows, components(links(rows, percent)))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                percent: int = PERCENT) -> DataFrame:
    """As ``near_duplicates``, with ``n_links``: how many other rows each row links with, copies included.

    A link between different sets is verified once, whatever copies its sets have."""
    rows = sets_of(docs, id_col, text_col, k, percent)
    nodes = nodes_of(rows)
    pairs = grouped_pairs(nodes.drop("body", "score").withColumn("part", F.col("grp_key")), percent, within=True)
    pairs = stored(verified(pairs, nodes, percent), "links")
    copies = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    degrees = copies.join(others, copies["node"] == others["a"], "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = classed(rows, components(pairs)).join(degrees, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
             percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, one of the smallest id; all rows without words stay.  Rows meet
    their component by the SHA-256 of the text and the id."""
    key = F.unhex(F.sha2(or_empty(F.col(text_col)), 256))
    rows = sets_of(docs, id_col, text_col, k, percent, key)
    _, least = named(rows, components(links(rows, percent)))
    kept = least.select(F.col("least.id").alias("__id"), F.col("least.key").alias("__kept"))
    worded = or_empty(F.col(text_col)).rlike(WORD)
    keyed = docs.where(worded).withColumn("__key", key)
    chosen = (F.col("__key") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__id"))
    one = keyed.join(kept, chosen, "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
    return one.union(docs.where(~worded))
