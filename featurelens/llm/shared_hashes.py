"""Which hashes occur in several documents: counting in Spark, without a row per hash.

Documents are dealt by id and text to groups (``grouped``), so that a null or repeated id does not fill one
task; only rows equal in both stay together.  Each group sends its distinct hashes, cut to 32
bits and packed, to one bucket task each (``count``); a bucket adds up in how many documents each
hash occurs and answers the groups that sent a hash found in two documents or more.  A hash that a third of
all documents hold is sent once by each group, not once by each document.  Cutting can only make
a hash look shared that is not, so it suits filters and orders, not decisions.

The number of buckets and groups follows ``spark.sql.shuffle.partitions``, which is to be set so that a
partition of the documents fits a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

SENT = "bucket int, grp int, keys binary, many binary, times binary"
ANSWER = "grp int, bucket int, keys binary, level binary"
U = np.uint64


def grouped(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``grp``, ``id``, ``text`` and the columns ``more``, shuffled by ``grp``; rows equal in id and text are in one group."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(2 * n)).cast("int").alias("grp"),
                       F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    return rows.repartition(n, "grp")


def cut(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each hash as one number."""
    return ((hashes % U(buckets)) << U(32)) | (hashes >> U(32))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, int)


def slices(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of each run."""
    return list(zip(at.tolist(), [*at[1:].tolist(), n], strict=True)) if len(at) else []


def documents_of(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the number of documents of each and the first of them (``doc`` ascends)."""
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, bool)
    keys, doc = keys[new], doc[new]
    at = runs(keys)
    return keys[at], np.diff(np.append(at, len(keys))), doc[at]


def packets(grp: int, keys: np.ndarray, times: np.ndarray) -> Iterator[dict]:
    """One row per bucket of distinct cut keys in order."""
    low = keys.astype(np.uint32)
    bucket = (keys >> U(32)).astype(np.int64)
    at = runs(bucket)
    for a, b in slices(at, len(keys)):
        many = np.flatnonzero(times[a:b] > 1)
        yield {"bucket": int(bucket[a]), "grp": grp, "keys": low[a:b].tobytes(), "many": many.astype(np.uint32).tobytes(),
               "times": times[a:b][many].astype(np.uint32).tobytes()}


SENT_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("many", pa.binary()),
                        ("times", pa.binary())])
ANSWER_ARROW = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("level", pa.binary())])


def level(times: np.ndarray) -> np.ndarray:
    """0 for one document, else 1 to 255, growing with the logarithm of their number."""
    return np.where(times < 2, 0, np.minimum(255, 4 * np.log2(np.maximum(times, 2)) - 3)).astype(np.uint8)


def answers(table: pa.Table) -> pa.Table:
    """Of one bucket: the keys found in two documents or more, for each group that sent them."""
    sent = [np.frombuffer(k.as_py(), np.uint32) for k in table["keys"]]
    times = []
    for keys, many, more in zip(sent, table["many"], table["times"], strict=True):
        t = np.ones(len(keys), np.int64)
        t[np.frombuffer(many.as_py(), np.uint32)] = np.frombuffer(more.as_py(), np.uint32)
        times.append(t)
    known, index = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate(times), minlength=len(known))
    height, out, at = level(total)[index], [], 0
    for keys, grp, bucket in zip(sent, table["grp"], table["bucket"], strict=True):
        mine = height[at:at + len(keys)]
        at += len(keys)
        if mine.any():
            out.append({"grp": grp.as_py(), "bucket": bucket.as_py(), "keys": keys[mine > 0].tobytes(),
                        "level": mine[mine > 0].tobytes()})
    return pa.Table.from_pylist(out, ANSWER_ARROW)


def count(docs: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
          by_id: bool = False) -> DataFrame:
    """``docs`` as ``grouped`` gives them; ``hashes``: hash and row of a batch's occurrences, by row.
    ``by_id``: rows of a group that share an id are one document.
    Result: per group and bucket the cut keys that two documents or more hold, and their ``level``."""
    from .words import parts

    buckets = shuffle_partitions(docs.sparkSession)

    def sent(key: tuple, table: pa.Table) -> pa.Table:
        found, doc, base = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
        number = np.arange(table.num_rows)
        if by_id:
            table = table.sort_by("id")
            number = np.array(table["id"].dictionary_encode().combine_chunks().indices.fill_null(-1))
        for batch in parts(table, "text"):
            h, row = hashes(batch)
            found.append(cut(h, buckets))
            doc.append(number[base + row].astype(np.int64))
            base += batch.num_rows
        keys, times, _ = documents_of(np.concatenate(found), np.concatenate(doc))
        return pa.Table.from_pylist(list(packets(key[0].as_py(), keys, times)), SENT_ARROW)

    return docs.groupBy("grp").applyInArrow(sent, SENT).groupBy("bucket").applyInArrow(answers, ANSWER)


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The answers to one group: cut keys in order, and their levels."""
    if not table.num_rows:
        return np.zeros(0, U), np.zeros(0, np.uint8)
    keys, levels = [], []
    for bucket, k, lev in zip(table["bucket"], table["keys"], table["level"], strict=True):
        keys.append(np.frombuffer(k.as_py(), np.uint32).astype(U) | (U(bucket.as_py()) << U(32)))
        levels.append(np.frombuffer(lev.as_py(), np.uint8))
    keys, levels = np.concatenate(keys), np.concatenate(levels)
    order = np.argsort(keys)
    return keys[order], levels[order]


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for those not known."""
    if not len(known):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], values.dtype.type(0))
