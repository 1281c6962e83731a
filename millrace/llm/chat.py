"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

A conversation log is a table of events (conv_id, seq, msg, kind, role, text):

- ``message``  opens message ``msg`` with a role and a text;
- ``delta``    appends its text to message ``msg`` (streamed output);
- ``edit``     replaces the text of message ``msg``;
- ``regenerate`` discards the text of ``msg``; the deltas after it rebuild it.

``fold_events`` brings the events of a message together, sorts them by ``seq``
and keeps the text from the last event that set it, with the deltas since.
``render`` then lays the final messages of a conversation out in order, and
``parse`` reads them back. The only shuffle is by ``conv_id`` (a message's events
are a subset of its conversation's, and the running offsets of a conversation's
turns are a window over it). A conversation is one row in the end, so it has to
fit a task.

Template: ``<|turn|>`` role ``\\n`` text ``<|end|>`` for each turn, nothing between.
Inside roles and texts ``~`` is written ``~0``, ``<`` ``~1``, ``[`` ``~2`` and, in
roles, a line feed ``~3``; so no control string that needs ``<`` or ``[`` can
occur in them, and ``~`` pairs are undone from left to right.

Defined results: a null text or role is empty; a message that only has deltas
has the role of its first event that names one; rows that are equal in
(seq, msg) are folded in order of kind and text; a null msg (first) or conv_id is a
value like any other, a null turn comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
KINDS = ("message", "delta", "edit", "regenerate")
#: Written for each reserved character, in the order of escaping.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """Undo ``escape``; ``~`` last, as ``~0`` may stand before a digit."""
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of the events."""
    ev = events.select(
        "conv_id", "msg",
        F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"),
    ).repartition("conv_id")
    log = ev.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("log"))
    sets = F.transform("log", lambda e: e["kind"] != "delta")
    start = F.coalesce(F.array_max(F.transform(sets, lambda s, i: F.when(s, i))), F.lit(0))
    kept = F.slice("log", start + 1, F.size("log"))
    texts = F.transform(kept, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"]))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.select(
        "conv_id", "msg",
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: code point spans [start, end) of assistant texts in ``formatted``."""
    pieces = messages.select(
        "conv_id", "msg", "role", "text",
        F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("msg", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turns = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("msg", "role", "text", "at", "head", "body"))).alias("turns")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["at"].cast("int").alias("start"), (t["at"] + F.length(t["body"])).cast("int").alias("end")),
    )
    return turns.select("conv_id", whole.alias("formatted"), spans.alias("mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END))).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def as_events(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as ``message`` events, each row a message of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text")
    return rows.select(
        "conv_id", F.col("turn").alias("seq"), F.row_number().over(order).alias("msg"),
        F.lit("message").alias("kind"), "role", "text",
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, mask of each conversation in the log."""
    return render(fold_events(events))
