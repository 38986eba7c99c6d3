"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

The size of a document is its number of words.  The sources share the budget (all words, or
``budget``) by weight; a source's target stops at ``max_epochs`` times its size, and the excess goes
to the others by weight until none is above.  That fixed point has a closed form: sort sources by
cap/weight; the capped ones are those whose ratio is at most the water level left by the ones before.
All sums are whole numbers, so targets do not depend on the order of rows.

A source then takes ``floor(target / size)`` whole repetitions of each document and one more of some:
documents in the order of a seeded hash as long as their running size stays within the remainder.
So the words taken differ from the target by less than one document, and reruns agree.  The running
size has two levels, 4096 hash buckets and documents in the one bucket where the remainder ends,
so that no task holds a source.

* Nulls: a null text has size 0; a null source is a source of its own, the last in order.
  A document of size 0 takes 0 words.  A null id is hashed as 'null'.
* Ties and repeated rows: rows that agree in id hash alike and are ordered by id and size;
  rows equal in both are interchangeable; ``mixed`` orders those by a hash of all columns.
* A source whose documents are all empty has target 0.  An empty table gives an empty result.
* Only the named columns are read; internal columns start with ``__``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, or_empty, stored

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, 17


def words(text: Column) -> Column:
    return F.regexp_count(or_empty(text), F.lit(WORD)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (``__source``, ``__total``), one row per source, with ``__target``.  The windows run over
    sources, not documents."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                                  ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("__total") * max_epochs)
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.withColumns({
        "__free": F.sum("__total").over(Window.partitionBy()) - F.coalesce(F.sum("__cap").over(before), F.lit(0)),
        "__wsum": F.sum("__w").over(Window.partitionBy()) - F.coalesce(F.sum("__w").over(before), F.lit(0))})
    # Capped ones form a prefix of the order: each leaves a level that is no lower than the one before.
    level = left.withColumn("__capped", F.col("__cap") * F.col("__wsum") <= F.col("__w") * F.col("__free"))
    first = F.when(~F.col("__capped"), F.struct("__wsum", "__free"))
    rest = F.max(first).over(Window.partitionBy())  # the first uncapped has the largest weight sum left
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(
        (F.col("__w") * rest["__free"]).cast("double") / rest["__wsum"])
    return level.select("__source", "__total", target.alias("__target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        carry: str | None = None) -> DataFrame:
    """Per document: ``id_col``, ``size``, ``source_size``, ``target`` (its source's), ``repeats``, ``taken``, and the column
    ``carry`` if one is named, which then orders rows equal in id and size."""
    more = [F.col(carry).alias("__row")] if carry else []
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    sized = stored(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                               words(F.col(text_col)).alias("__size"), key.alias("__key"), *more)
                   .withColumn("__bucket", F.substring("__key", 1, 3)), "sizes")
    buckets = sized.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__bsize"))
    totals = buckets.groupBy("__source").agg(F.sum("__bsize").alias("__total"))
    targets = water_fill(totals, weights, max_epochs)
    whole = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0))
    plan = targets.withColumn("__whole", whole.cast("long")).withColumn(
        "__extra", F.col("__target") - F.col("__whole") * F.col("__total"))
    run = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = buckets.withColumn("__below", F.coalesce(F.sum("__bsize").over(run), F.lit(0)))
    plan = edges.alias("b").join(plan.alias("p"), F.col("b.__source").eqNullSafe(F.col("p.__source"))).select(
        F.col("b.__source").alias("__s"), F.col("b.__bucket").alias("__b"), "__total", "__target", "__whole", "__extra",
        "__below", F.when(F.col("__below") + F.col("__bsize") <= F.col("__extra"), "in")
        .when(F.col("__below") >= F.col("__extra"), "out").otherwise("edge").alias("__place"))
    placed = sized.join(plan, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    # Only the one bucket of a source in which the remainder ends is ordered document by document.
    inside = Window.partitionBy("__s", "__b").orderBy(
        "__key", "__id", "__size", *["__row"][:len(more)]).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("__place = 'edge'").withColumn("__more", (
        F.col("__below") + F.sum("__size").over(inside) <= F.col("__extra")).cast("long"))
    rest = placed.where("__place != 'edge'").withColumn("__more", (F.col("__place") == "in").cast("long"))
    both = edge.unionByName(rest).withColumn("__repeats", F.col("__whole") + F.col("__more"))
    return both.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__total").alias("source_size"),
                       F.col("__target").alias("target"), F.col("__repeats").alias("repeats"),
                       (F.col("__size") * F.col("__repeats")).alias("taken"),
                       *[F.col("__row").alias(carry) for _ in more])


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with each row repeated as often as ``mix`` takes it.  Rows are told apart by id and a hash of all columns;
    equal rows are interchangeable, so one of them stands for all, as often as they are taken together."""
    keyed = docs.withColumn("__hash", F.xxhash64(*docs.columns))
    taken = mix(keyed, id_col, carry="__hash", **how).groupBy(F.col(id_col).alias("__id"), F.col("__hash").alias("__same")).agg(
        F.sum("repeats").alias("__n"))
    one = keyed.dropDuplicates([id_col, "__hash"])
    joined = one.join(taken.where("__n > 0"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__same")))
    repeated = joined.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return repeated.select(*docs.columns)
