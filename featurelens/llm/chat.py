"""Chat formatting from event logs (DataFrame functions only).

``fold`` reconstructs conversations from their logs.  An event has a conversation, a sequence number,
a kind, the message it concerns, a role and a text:

* ``message``     opens a version of the message with role and text;
* ``delta``       appends its text to the version open at its sequence number;
* ``edit``        opens a version with a new text (and role, if it gives one);
* ``regenerate``  opens an empty version and withdraws all later messages logged before it.

Events are partitioned by conversation and ordered by sequence (windows over one conversation); of
each message the last version stays, its texts joined in order.  ``render`` writes one string per
conversation::

    <|im_start|>role\\ntext<|im_end|>\\n

and escapes the control strings in roles and texts reversibly: ``\\`` becomes ``\\s``, ``<|`` becomes
``<\\p`` and, in roles, a line feed ``\\n``.  Every backslash of an escaped string is followed by one
code letter, so ``unescape`` is three plain replacements.  ``loss_spans`` holds (start, length) in
code points of each trained message's escaped text in ``formatted``.

* Nulls: a null text or role is empty; a null conversation id is a conversation of its own; a null
  sequence number comes first.  An event of unknown kind is ignored.
* Ties: events with the same sequence number are ordered by message, kind, role and text.
* Deltas without an open version open one.  An empty table gives an empty result.
* One conversation is one output row, so it must fit a task; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import or_empty

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    pairs = (("\\n", "\n"), ("\\p", "|"), ("\\s", "\\"))
    for code, plain in pairs:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "event", message: str = "message",
         role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: ``__conv``, ``__message``, ``__role``, ``__text``, ``__at`` (place in the conversation)."""
    log = events.select(F.col(conv).alias("__conv"), F.col(seq).alias("__seq"), F.col(kind).alias("__kind"),
                        F.col(message).alias("__message"), F.col(role).alias("__role"),
                        or_empty(F.col(text)).alias("__text")).where(F.col("__kind").isin(*KINDS))
    order = ["__seq", "__message", "__kind", "__role", "__text"]
    log = log.withColumn("__n", F.row_number().over(Window.partitionBy("__conv").orderBy(*order)))
    # The last regeneration of any earlier message withdraws what was logged of this one before it.
    earlier = Window.partitionBy("__conv").orderBy(F.col("__message").asc_nulls_first()).rangeBetween(
        Window.unboundedPreceding, -1)
    redone = F.when(F.col("__kind") == "regenerate", F.col("__n"))
    log = log.withColumn("__cut", F.max(redone).over(earlier)).where("__cut is null or __n > __cut")
    one = Window.partitionBy("__conv", "__message").orderBy("__n")
    opens = F.col("__kind") != "delta"
    log = log.withColumn("__version", F.sum(opens.cast("int")).over(one))
    log = log.withColumn("__role", F.last(F.when(opens, F.col("__role")), ignorenulls=True).over(one))
    last = F.max("__version").over(Window.partitionBy("__conv", "__message"))
    log = log.withColumn("__last", last).where("__version = __last")
    parts = log.groupBy("__conv", "__message").agg(
        F.array_sort(F.collect_list(F.struct("__n", "__text"))).alias("__parts"),
        F.max_by("__role", "__n").alias("__role"))
    text_of = F.array_join(F.transform("__parts", lambda p: p["__text"]), "")
    return parts.select("__conv", "__message", or_empty(F.col("__role")).alias("__role"), text_of.alias("__text"),
                        F.col("__message").alias("__at"))


def render(messages: DataFrame, trained: Sequence[str] = TRAINED, conv_name: str = "conv_id") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (array of start, length)."""
    head = F.concat(F.lit(START), escape_role(F.col("__role")), F.lit("\n"))
    turns = messages.select("__conv", "__at", head.alias("__head"), escape(F.col("__text")).alias("__body"),
                            F.col("__role").isin(*trained).alias("__loss"))
    turns = turns.withColumn("__turn", F.concat("__head", "__body", F.lit(END + "\n")))
    upto = Window.partitionBy("__conv").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("__turn")).over(upto) - F.length("__turn") + F.length("__head")
    span = F.struct(start.alias("start"), F.length("__body").cast("long").alias("length"))
    turns = turns.withColumn("__span", F.when(F.col("__loss"), span))
    joined = turns.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct("__at", "__turn", "__span"))).alias("__m"))
    formatted = F.array_join(F.transform("__m", lambda x: x["__turn"]), "")
    spans = F.filter(F.transform("__m", lambda x: x["__span"]), lambda x: x.isNotNull())
    return joined.select(F.col("__conv").alias(conv_name), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation, unescaped."""
    bodies = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    plain = F.transform(bodies, lambda b: F.substring(b, F.lit(1), F.length(b) - len(END) - 1))

    def parsed(b):
        return F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"),
                        unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text"))

    return F.transform(plain, parsed)


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(cut, unescape), "")


def events_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """A table of finished turns as a log of ``message`` events, one message a row, ordered by turn
    (then role and text, where turns tie)."""
    at = F.row_number().over(Window.partitionBy(conv).orderBy(turn, role, text)).cast("long")
    return rows.select(F.col(conv).alias("conv_id"), at.alias("seq"), F.lit("message").alias("event"),
                       at.alias("message"), F.col(role).alias("role"), F.col(text).alias("text"))
