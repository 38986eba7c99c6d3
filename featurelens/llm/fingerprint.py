"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap.

A feature is a window of ``FEATURE`` bytes.  Its entropy, on a scale of 0 to ``SCALE``, has a rarity: the rank of how many
windows of the whole corpus share it (``rarity``; ``SCALE + 1`` numbers).  Entropies up to a tenth of the scale
(padding, ruled lines) say little and rank after all others.  Every ``AROUND`` neighbouring features elect the rarest, the
leftmost of equals; at either end fewer than ``AROUND`` take part, so each feature stands in ``AROUND`` elections.  Features
elected ``VOTES`` times or more are selected, equal ones once.  In text order they fill filters of ``BITS`` bits, ``HASHES``
bits a feature, at most ``FILL`` features a filter; the filters, one after the other, are the fingerprint.

Likeness of two filters: common bits above those expected by chance plus ``CUT`` of the range from there to all bits of the
smaller one, divided by what is left of that range; 0 below.  Likeness of two fingerprints: for each filter of the one with fewer filters
the best in the other, averaged by bits set (with as many filters, the mean of both directions).

Entropies are exact: sliding sums of whole numbers, from how often a byte occurs among the 63 before and after it.  So a
fingerprint depends on the text and the corpus' rarities only; equal texts have equal fingerprints.

* A null text counts as empty.  An empty text has an empty fingerprint; two empty ones are alike to 1, an
  empty and another to 0.  A text shorter than a feature is one feature, filled up with its length.
* ``with_next`` orders rows by id (nulls first), then by hash and text; rows equal in both are interchangeable.  The row after the
  last is the first, so a single row is its own next.  Ids are whole numbers.
* Empty tables give empty results.  ``fingerprints`` keeps input columns but those named like the result; ``with_next``
  reads the named columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import or_empty, shuffle_partitions
from .words import mix

FEATURE, AROUND, VOTES = 64, 64, 16
BITS, HASHES, FILL = 2048, 5, 160
SCALE, CUT = 1000, 0.3
#: Bytes of text fingerprinted at a time, and bytes compared in one step.
PIECE, STEP = 1 << 20, 1 << 15
#: Sampled keys for each bound of ``with_next``.
SAMPLED = 32
U = np.uint64
NONE = np.iinfo(np.int64).max
#: c log2 c in units of 2^-20, for c equal bytes in a window; and what one more adds.
WEIGHT = np.array([0] + [round(c * np.log2(c) * (1 << 20)) for c in range(1, FEATURE + 1)], np.int64)
GAIN = np.diff(WEIGHT)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy (0 to ``SCALE``) of the window from each byte on, of all that fit."""
    n = len(data)
    if n < FEATURE:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + FEATURE, np.uint8)
    padded[:n] = data
    before, after = np.zeros(n + FEATURE, np.uint8), np.zeros(n + FEATURE, np.uint8)
    same = np.empty(STEP, bool)
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        here, hit = padded[a:b], same[:b - a]
        for d in range(1, FEATURE):
            np.equal(here, padded[a + d:b + d], out=hit)
            as_number = hit.view(np.uint8)
            after[a:b] += as_number
            before[a + d:b + d] += as_number
    total = np.empty(n - FEATURE + 1, np.int64)
    total[0] = WEIGHT[np.bincount(data[:FEATURE])].sum()
    total[1:] = GAIN[before[FEATURE:n]] - GAIN[after[:n - FEATURE]]
    np.cumsum(total, out=total)
    return (WEIGHT[FEATURE] - total) * SCALE // WEIGHT[FEATURE]


def within(offset: np.ndarray, n: int) -> np.ndarray:
    """Which of the first ``n`` windows lie in one text; ``offset``: where each text begins, and the end."""
    whole = np.diff(offset) >= FEATURE
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offset[:-1][whole], 1)
    np.add.at(edge, offset[1:][whole] - FEATURE + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rarity of each entropy from the number of windows that have it: rarest first, equal counts by entropy, uninformative last."""
    entropy = np.arange(SCALE + 1)
    order = np.lexsort((entropy, counts, entropy <= SCALE // 10))
    ranks = np.empty(SCALE + 1, np.int64)
    ranks[order] = entropy
    return ranks


def selected(data: np.ndarray, offset: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places in ``data`` of the features selected, in order; ``offset``: where each text begins, and the end."""
    value = entropies(data)
    inside = within(offset, len(value))
    place = np.arange(len(value))
    key = np.full(len(value) + 2 * (AROUND - 1), NONE)
    key[AROUND - 1:len(key) - AROUND + 1] = np.where(inside, ranks[value] << 32 | place, NONE)
    span = 1
    while span < AROUND:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    votes = np.bincount(key[key != NONE] & 0xFFFFFFFF, minlength=len(value)) if len(value) else np.zeros(0, np.int64)
    at = np.flatnonzero(votes >= VOTES)
    return np.searchsorted(offset, at, "right") - 1, at


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """The fingerprint of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc, at = selected(data, offset, ranks)
    window = data[at[:, None] + np.arange(FEATURE)] if len(at) else np.zeros((0, FEATURE), np.uint8)
    short = np.flatnonzero((size > 0) & (size < FEATURE))
    if len(short):
        filled = [texts[i].ljust(FEATURE, bytes([len(texts[i])])) for i in short]
        window = np.concatenate([window, np.frombuffer(b"".join(filled), np.uint8).reshape(-1, FEATURE)])
        doc, at = np.concatenate([doc, short]), np.concatenate([at, offset[short]])
    hashes = hash_of(np.ascontiguousarray(window))
    order = np.lexsort((at, hashes, doc))
    doc, at, hashes = doc[order], at[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    order = np.flatnonzero(first)[np.argsort(at[first], kind="stable")]  # texts follow each other, so by place is by text
    doc, hashes = doc[order], hashes[order]
    count = np.bincount(doc, minlength=len(texts))
    filters = -(-count // FILL)
    base = np.cumsum(filters) - filters
    number = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    which = base[doc] + number // FILL
    bits = np.zeros(int(filters.sum()) * BITS, np.uint8)
    for k in range(HASHES):
        bits[which * BITS + (hashes >> U(11 * k) & U(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits).tobytes()
    each = BITS // 8
    return [packed[b * each:(b + f) * each] for b, f in zip(base.tolist(), filters.tolist(), strict=True)]


def hash_of(window: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window (rows of ``FEATURE`` bytes)."""
    total = np.zeros(len(window), U)
    for i, part in enumerate(window.view("<u8").T):
        total = mix(total ^ mix(part + U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))))
    return total


def filters(fingerprint: bytes) -> np.ndarray:
    return np.frombuffer(fingerprint, "<u8").reshape(-1, BITS // 64)


def one_way(a: np.ndarray, b: np.ndarray) -> float:
    """For each filter of ``a`` the best in ``b``, averaged by bits set."""
    many_a, many_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a))
    for i, one in enumerate(a):
        common = np.bitwise_count(one & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(many_a[i], many_b)
        chance = many_a[i] * many_b / BITS
        floor = chance + CUT * (most - chance)
        best[i] = np.maximum(0, (common - floor) / (most - floor)).max()
    return float((best * many_a).sum() / many_a.sum())


def alike(one: bytes, other: bytes) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a, b = filters(one), filters(other)
    if len(a) == len(b):
        return (one_way(a, b) + one_way(b, a)) / 2
    return one_way(a, b) if len(a) < len(b) else one_way(b, a)


def gathered(texts: Iterator[bytes | None]) -> Iterator[list[bytes]]:
    """Lists of texts of about ``PIECE`` bytes, one text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy by the number of windows, in all texts, that have it (one row an entropy reaches the driver)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SCALE + 1, np.int64)
        for batch in batches:
            for texts in gathered(t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(0)):
                value = entropies(np.frombuffer(b"".join(texts), np.uint8))
                offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                total += np.bincount(value[within(offset, len(value))], minlength=SCALE + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["entropy", "n"])

    found = docs.select(text_col).mapInArrow(counted, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n"))
    counts = np.zeros(SCALE + 1, np.int64)
    for r in found.collect():
        counts[r["entropy"]] = r["n"]
    return ranks_of(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` without ``text_col`` and with ``out``, the fingerprint (binary)."""
    rows = docs.select(*[F.col(c) for c in docs.columns if c not in (text_col, out)], F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(batch.num_columns - 1))
            found = [d for some in gathered(texts) for d in digests(some, ranks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=schema.names)

    return rows.mapInArrow(made, schema)


@F.pandas_udf(T.DoubleType())
def likeness(one: pd.Series, other: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns; null counts as empty."""
    return pd.Series([alike(a or b"", b or b"") for a, b in zip(one, other, strict=True)], dtype=float)


def bounds(keys: DataFrame, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``wanted`` keys (``id``, ``h``) in order that part the rows about evenly, from about ``SAMPLED`` times as many
    keys taken by their hash."""
    one_in = max(1, keys.count() // (SAMPLED * wanted))
    taken = keys.where(F.pmod(F.xxhash64("id", "h"), F.lit(one_in)) == 0).distinct().collect()
    taken = sorted((r["id"], r["h"]) for r in taken)
    step = max(1, -(-len(taken) // (wanted + 1)))
    taken = taken[step::step]
    return np.array([t[0] for t in taken], np.int64), np.array([t[1] for t in taken], np.int64)


def bucket_of(ids: np.ndarray, hashes: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds are at most each key."""
    bid, bhash = low
    left, right = np.searchsorted(bid, ids, "left"), np.searchsorted(bid, ids, "right")
    out = left.copy()
    for i in np.unique(left[left < right]):  # ids that are bounds themselves: by hash
        j = np.searchsorted(bid, bid[i], "right")
        mine = (left == i) & (right == j)
        out[mine] = i + np.searchsorted(bhash[i:j], hashes[mine], "right")
    return out


def with_next(docs: DataFrame, each: Callable[[list[tuple[str, str]]], dict[str, list]], schema: str,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and what ``each`` finds for lists of (text, text of the row after it); ``schema``: of its columns.

    Rows are dealt to ranges of (id, hash of the text) whose bounds are constants, sorted there and read as a stream; each range
    also gets the first row of the range after it.  So the texts are shuffled once, no task holds a range, and a lost task
    finds the same rows again.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), or_empty(F.col(text_col)).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    as_key = F.coalesce(F.col("id"), F.lit(np.iinfo(np.int64).min)).alias("id")
    low = bounds(rows.select(as_key, "h"), ranges - 1)

    @F.pandas_udf(T.IntegerType())
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64), low), dtype="int32")

    rows = rows.withColumn("bucket", bucket(as_key, "h"))
    # the first row of each range, at most ``ranges``: by key, then, of rows equal in it, by text
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "h")).alias("k")).select(
        "bucket", F.col("k.id").alias("hid"), F.col("k.h").alias("hh"))
    first = rows.join(F.broadcast(heads.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b"))
                      & F.col("id").eqNullSafe(F.col("hid")) & (F.col("h") == F.col("hh")))
    first = first.groupBy("bucket", "id", "h").agg(F.min("text").alias("text")).collect()
    order = sorted(r["bucket"] for r in first)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    lent = spark.createDataFrame([(before[r["bucket"]], True, r["id"], r["h"], r["text"]) for r in first],
                                 "bucket int, lent boolean, id long, h long, text string")
    dealt = rows.select("bucket", F.lit(False).alias("lent"), "id", "h", "text").unionByName(lent)
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions(
        "bucket", "lent", F.col("id").asc_nulls_first(), "h", "text").select("bucket", "lent", "id", "text")
    out = T.StructType([T.StructField(id_col, T.LongType()), *T._parse_datatype_string(schema).fields])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        held = None
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                for b, borrowed, i, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if held and held[0] == b:
                        yield held[1], held[2], text
                    held = None if borrowed else (b, i, text)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0

        def done() -> pa.RecordBatch:
            found = each(held)
            columns = [pa.array(ids, pa.int64()), *(pa.array(found[n]) for n in out.names[1:])]
            return pa.RecordBatch.from_arrays(columns, names=out.names)

        for i, text, after in pairs(batches):
            ids.append(i)
            held.append((text, after))
            size += len(text)
            if size >= PIECE:
                yield done()
                ids, held, size = [], [], 0
        if ids:
            yield done()

    return dealt.mapInArrow(streamed, out)


def compare_edited(docs: DataFrame, ranks: np.ndarray, edit: Callable[[str, str], str], id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: ``n_chars``, ``edited`` (what ``edit`` makes of the text and the next one), ``fingerprint`` and
    ``edited_fingerprint`` (binary), ``near_edited`` and ``near_next``."""
    def each(held: list[tuple[str, str]]) -> dict[str, list]:
        edited = [edit(a, b) for a, b in held]
        last = held[-1][1]
        own = digests([a.encode() for a, _ in held] + [last.encode()], ranks)
        # within a range the next text is the next row's; where ranges meet it is not
        after = [own[i + 1] if i + 1 == len(held) or held[i][1] == held[i + 1][0] else digests([b.encode()], ranks)[0]
                 for i, (_, b) in enumerate(held)]
        own = own[:-1]
        changed = digests([e.encode() for e in edited], ranks)
        return {"n_chars": [len(a) for a, _ in held], "edited": edited, "fingerprint": own, "edited_fingerprint": changed,
                "near_edited": [alike(a, b) for a, b in zip(own, changed, strict=True)],
                "near_next": [alike(a, b) for a, b in zip(own, after, strict=True)]}

    return with_next(docs, each, "n_chars long, edited string, fingerprint binary, edited_fingerprint binary, "
                                 "near_edited double, near_next double", id_col, text_col)


def tail_replaced(text: str, after: str) -> str:
    """``text`` with its last quarter of code points (rounded down) replaced by the first as many of ``after``, or all."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


def encoded(fingerprint: Column) -> Column:
    return F.base64(fingerprint)
