"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so (after a sentence end or line break, at least ``MIN_CHUNK``
characters after the last cut, at most ``MAX_CHUNK``), and its recipe is the ordered list of its
chunks' identifiers.  Equal texts are cut alike, so texts are equal exactly if their recipes are,
provided that an identifier stands for one chunk text.  That is verified: each distinct chunk moves
once, next to the others of its identifier; an identifier that two chunk texts share (a hash
collision) is void, and texts holding such a chunk are compared by text besides.  Long documents
move once, in chunks; all later steps move 8 bytes a chunk.

Equality is of texts after lower-casing A-Z only; null counts as empty.

* Nulls: a null text equals an empty one; a null id is the smallest, so it stays only where all ids
  of its group are null.
* Ties and repeated rows: of rows that share the largest id all are marked kept by ``dedup``;
  ``keep_one`` leaves one of them.  It decides by row, not by id: one row of each text stays, also
  where texts share an id or have none.
* An empty table gives an empty result.  Columns of the input never clash with internal names:
  only the two named columns are read, and internal columns start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, or_empty, stored

MIN_CHUNK, MAX_CHUNK = 512, 8192
SALTS = 32


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Array of content-defined chunks; joined they give ``text``; empty for an empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}}"), F.lit(0))


def identifiers(pieces: Column) -> Column:
    return F.transform(pieces, lambda c: F.xxhash64(c))


def void_identifiers(normal: DataFrame, text: str = "__text") -> DataFrame:
    """Identifiers (column ``id``) that stand for more than one chunk text."""
    pieces = normal.select(F.explode(F.array_distinct(chunks(F.col(text)))).alias("chunk"))
    pieces = pieces.select(F.xxhash64("chunk").alias("id"), "chunk")
    return pieces.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: ``__id``, ``sha256`` of the normalised text, ``recipe`` (array of
    identifiers) and ``by_text`` (the normalised text where the recipe holds a void identifier, else '')."""
    normal = docs.select(F.col(id_col).alias("__id"), fold_ascii(or_empty(F.col(text_col))).alias("__text"))
    # At most a handful: n distinct chunks collide n^2 / 2^65 times on average (270 for 10^11 chunks).
    void = void_identifiers(normal).agg(F.collect_list("id").alias("ids")).scalar()
    recipe = normal.select("__id", "__text", F.sha2("__text", 256).alias("sha256"),
                           identifiers(chunks(F.col("__text"))).alias("recipe"))
    return recipe.select("__id", "sha256", "recipe", F.when(F.arrays_overlap("recipe", void), F.col("__text"))
                         .otherwise(F.lit("")).alias("by_text"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, ``keep_id`` (largest id of its group), ``group_size``, ``kept``, ``text_sha256``."""
    rows = stored(recipes(docs, id_col, text_col), "recipes")
    groups = rows.groupBy("recipe", "by_text").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    # A group may hold a third of all rows: its rows are dealt to SALTS join keys, and groups of one need no join.
    salted = groups.where("__size > 1").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", F.lit("salt")), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, ["recipe", "by_text", "__salt"], "left")
    alone = F.col("__size").isNull()
    keep = F.when(alone, F.col("__id")).otherwise(F.col("__keep"))
    return joined.select(F.col("__id").alias(id_col), keep.alias("keep_id"),
                         F.coalesce("__size", F.lit(1)).alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"),
                         F.col("sha256").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, one whose id is the group's ``keep_id``.  Rows meet their group by
    the SHA-256 of the normalised text and the id."""
    kept = dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__kept"))
    keyed = docs.withColumn("__key", F.sha2(fold_ascii(or_empty(F.col(text_col))), 256))
    named = (F.col("__key") == F.col("__kept")) & F.col(id_col).eqNullSafe(F.col("__keep"))
    return keyed.join(kept.distinct(), named, "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
