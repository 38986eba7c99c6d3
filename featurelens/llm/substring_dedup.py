"""Substring dedup: repeated windows of ``WINDOW`` words are removed where they occur later.

Every window of 50 consecutive words gets a Rabin-Karp hash.  Spark counts them twice: first cut to 32
bits, which rules out most windows as unique at 4 bytes each, then those left by their whole hash, with
the smallest document id that holds each.  A window is repeated in a document if one with a smaller id
holds it, too; overlapping repeated windows merge into maximal removal intervals, and the words outside
them stay.  Windows are judged on the input, not on what is left.

The texts are shuffled once, by id and text; all three passes read that shuffle.  Rows of one id may be in
several groups: the first count may then take a window of that id alone for repeated, which the second,
by smallest ids, undoes.  A window that very many
documents hold is sent once by each group of documents.

* Nulls: a null text has no words; a row whose id is null has no order among the others, so none of its
  words is removed and none of its windows counts.
* Repeated rows: rows with the same id are one document in the comparison, and each keeps its row.
* Documents of fewer than 50 words have no window.  An empty table gives an empty result.
* Very long texts are hashed whole, a document at a time.  Only the two named columns are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared_hashes as sh
from .common import shuffle_partitions
from .words import parts, windows, words

WINDOW = 50
U = np.uint64
SENT = "bucket int, grp int, hashes binary, firsts binary, several binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("hashes", pa.binary()), ("firsts", pa.binary()),
                        ("several", pa.binary())])
ANSWER = "grp int, hashes binary, owner binary"
ANSWER_ARROW = pa.schema([("grp", pa.int32()), ("hashes", pa.binary()), ("owner", pa.binary())])
OUT = "id long, n_words long, spans array<struct<start:long,stop:long>>, kept string"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def window_hashes(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = words(batch.column("text"))
    first, h = windows(w, k)
    row = w.doc[first]
    known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)[row]
    return h[known], row[known]


def send(docs: pa.Table, shared: pa.Table, grp: int, buckets: int, k: int) -> pa.Table:
    """A group's windows that may be repeated: distinct hashes, the smallest id of each, and whether
    several documents of the group hold it."""
    docs = docs.sort_by("id")
    known, levels = sh.answered(shared)
    ids = docs["id"].to_numpy() if not docs["id"].null_count else docs["id"].fill_null(0).to_numpy()
    number = np.unique(ids, return_inverse=True)[1]
    found, doc, base = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    for batch in parts(docs, "text"):
        h, row = window_hashes(batch, k)
        maybe = sh.look_up(sh.cut(h, buckets), known, levels) > 0
        found.append(h[maybe])
        doc.append(base + row[maybe])
        base += batch.num_rows
    found, doc = np.concatenate(found), np.concatenate(doc)
    order = np.argsort(number[doc], kind="stable")
    keys, times, first = sh.documents_of(found[order], number[doc[order]])
    smallest = np.unique(ids)[first]
    bucket = (keys % U(buckets)).astype(np.int64)
    order = np.lexsort((first, bucket))
    keys, times, smallest, bucket = keys[order], times[order], smallest[order], bucket[order]
    at = sh.runs(bucket)
    rows = [{"bucket": int(bucket[a]), "grp": grp, "hashes": keys[a:b].tobytes(),
             "firsts": smallest[a:b].astype(np.int64).tobytes(), "several": np.packbits(times[a:b] > 1).tobytes()}
            for a, b in sh.slices(at, len(keys))]
    return pa.Table.from_pylist(rows, SENT_ARROW)


def answers(table: pa.Table) -> pa.Table:
    """Of one bucket: for each group the hashes of windows to remove.  ``owner``: the group holds
    the smallest id, where the window stays."""
    sent = [np.frombuffer(h.as_py(), U) for h in table["hashes"]]
    first = np.concatenate([np.frombuffer(f.as_py(), np.int64) for f in table["firsts"]])
    several = np.concatenate([np.unpackbits(np.frombuffer(s.as_py(), np.uint8), count=len(h)).astype(bool)
                              for s, h in zip(table["several"], sent, strict=True)])
    hashes = np.concatenate(sent)
    order = np.argsort(hashes, kind="stable")
    at = sh.runs(hashes[order])
    smallest = np.empty(len(hashes), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(first[order], at), np.diff(np.append(at, len(hashes))))
    owner, out, i = first == smallest, [], 0
    for grp, h in zip(table["grp"], sent, strict=True):
        mine = slice(i, i + len(h))
        i += len(h)
        told = ~owner[mine] | several[mine]
        if told.any():
            out.append({"grp": grp.as_py(), "hashes": h[told].tobytes(), "owner": owner[mine][told].tobytes()})
    return pa.Table.from_pylist(out, ANSWER_ARROW)


def intervals(starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal intervals that windows of ``k`` words starting at ``starts`` (ascending) cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + k)))
    last = np.append(new[1:], len(starts)) - 1
    return [(int(a), int(b) + k) for a, b in zip(starts[new], starts[last], strict=True)]


def without(text: bytes, spans: list[tuple[int, int]]) -> str:
    split = text.split()  # bytes split at exactly the white space that words() knows
    kept, at = [], 0
    for a, b in spans:
        kept += split[at:a]
        at = b
    return b" ".join(kept + split[at:] if spans else split).decode()


def remove(docs: pa.Table, repeated: pa.Table, k: int) -> pa.Table:
    docs = docs.sort_by("id")
    if repeated.num_rows:
        known = np.concatenate([np.frombuffer(h.as_py(), U) for h in repeated["hashes"]])
        value = np.concatenate([np.frombuffer(o.as_py(), bool) for o in repeated["owner"]]).astype(np.int8) + np.int8(1)
        order = np.argsort(known)
        known, value = known[order], value[order]
    else:
        known, value = np.zeros(0, U), np.zeros(0, np.int8)
    first_doc: dict[int, int] = {}  # of hashes that this group owns: the smallest id, met first
    out = []
    for batch in parts(docs, "text"):
        w = words(batch.column("text"))
        first, h = windows(w, k)
        found = sh.look_up(h, known, value)
        ids = batch.column("id").to_pylist()
        named = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        gone = (found > 0) & named[w.doc[first]]
        for i in np.flatnonzero(gone & (found == 2)).tolist():
            doc_id = ids[w.doc[first[i]]]
            gone[i] = first_doc.setdefault(int(h[i]), doc_id) != doc_id
        starts = first[gone]
        begin = np.concatenate(([0], np.cumsum(w.count)))
        at = np.searchsorted(starts, begin)
        for d, doc_id in enumerate(ids):
            spans = intervals(starts[at[d]:at[d + 1]] - begin[d], k)
            raw = w.data[w.offset[d]:w.offset[d + 1]].tobytes()
            out.append((doc_id, int(w.count[d]), spans, without(raw, spans)))
    return pa.table({"id": pa.array([o[0] for o in out], pa.int64()), "n_words": pa.array([o[1] for o in out], pa.int64()),
                     "spans": pa.array([[{"start": a, "stop": b} for a, b in o[2]] for o in out], SPAN),
                     "kept": pa.array([o[3] for o in out], pa.string())})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``spans`` (removed words, as maximal intervals) and ``kept`` (the
    words that stay, joined by one space)."""
    buckets = shuffle_partitions(docs.sparkSession)
    texts = sh.grouped(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col)
    shared = sh.count(texts, lambda batch: window_hashes(batch, k), by_id=True)

    def sent(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return send(left, right, key[0].as_py(), buckets, k)

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        return remove(left, right, k)

    maybe = texts.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(sent, SENT)
    repeated = maybe.groupBy("bucket").applyInArrow(answers, ANSWER)
    out = texts.groupBy("grp").cogroup(repeated.groupBy("grp")).applyInArrow(removed, OUT)
    return out.withColumnRenamed("id", id_col)
