"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation is a log of events ``(conv_id, seq, kind, message_id, role,
text)``. Kinds:

* ``message``: begins a message; if its id is there, its text is replaced in place;
* ``delta``: appends text to the message;
* ``edit``: replaces the message's text;
* ``regenerate``: empties the message and drops every message begun since;
* ``delete``: drops the message.

An event without an id means the message last begun or regenerated (a ``message``
without an id is one of its own). The first event of an id begins it, whatever its
kind. After a ``delete`` the id is free: a ``message`` begins a new one there, other
events up to then are dropped. What a regeneration drops stays dropped, with late
events of it: it is the branch that was left.

Folding is a window over the log: the number of deletions so far is a message's
life, the number of resets in it its version, and only the last version's texts are
kept and joined. One shuffle by ``conv_id`` serves the windows and both aggregations.

Defined cases: null texts and roles count as empty; a null kind is ``message``;
events of equal ``seq`` are taken by kind, id, role and text, so ties and
repeated rows give the same result on every run; a null ``conv_id`` is one
conversation of its own; other columns are ignored; no rows give no rows. A
conversation is one row of the result, so one conversation is one task's work
and must fit in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("message", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """Marks of a turn. Each must hold ``<``, which escaped texts never do."""

    turn: str = "<turn>"
    after_role: str = "\n"
    loss: str = "<loss>"
    end_loss: str = "</loss>"
    end_turn: str = "</turn>\n"
    trained_role: str = "assistant"


def escape(text: Column) -> Column:
    """Reversible: afterwards ``<`` does not occur, and ``&`` only before ``amp;`` or ``lt;``."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, position, role, text``, position ascending in each conversation."""
    log = Window.partitionBy("conv_id").orderBy("seq", "kind", "message_id", "role", "text")
    message = Window.partitionBy("conv_id", "message")
    e = events.select(
        "conv_id",
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("message_id").cast("string").alias("message_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("at", F.row_number().over(log))
    own = F.when(F.col("message_id").isNotNull(), F.concat(F.lit("id:"), "message_id")).when(F.col("kind") == "message", F.concat(F.lit("at:"), F.col("at")))
    so_far = Window.partitionBy("conv_id").orderBy("at")
    opened = F.last(F.when(F.col("kind").isin("message", "regenerate"), F.col("message")), ignorenulls=True).over(so_far)
    e = e.withColumn("message", own).withColumn("message", F.coalesce("message", opened, F.lit("none")))
    before = Window.partitionBy("conv_id", "message").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    life = Window.partitionBy("conv_id", "message", "life")
    e = (
        e.withColumn("life", F.coalesce(F.sum((F.col("kind") == "delete").cast("int")).over(before), F.lit(0)))
        .withColumn("begun", (F.col("life") == 0) | F.max(F.col("kind") == "message").over(life.orderBy("at")))
        .where("begun")
        .withColumn("version", F.sum(F.col("kind").isin(*RESETS).cast("int")).over(life.orderBy("at")))
        .withColumn("last_version", F.max("version").over(life))
        .withColumn("start", F.min("at").over(life))
    )
    # a message is dropped if a later regenerate aims at one that began before it
    ahead = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    e = e.withColumn("back_to", F.min(F.when(F.col("kind") == "regenerate", F.col("start"))).over(ahead))
    piece = F.when((F.col("version") == F.col("last_version")) & (F.col("kind") != "delete"), F.struct("at", "text"))
    return (
        e.groupBy("conv_id", "message", "life")
        .agg(
            F.min("at").alias("position"),
            F.min_by("role", F.when(F.col("role") != "", F.col("at"))).alias("role"),
            F.min_by("back_to", "at").alias("back_to"),
            F.max(F.col("kind") == "delete").alias("deleted"),
            F.array_sort(F.collect_list(piece)).alias("pieces"),
        )
        .where(~F.col("deleted") & (F.col("back_to").isNull() | (F.col("back_to") >= F.col("position"))))
        .select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))
    )


def format_conversations(events: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans``: spans are (start, length) in code points of ``formatted``, from 0."""
    t = template
    trained = F.col("role") == t.trained_role
    head = F.concat(F.lit(t.turn), _escape_role(F.col("role")), F.lit(t.after_role))
    turns = (
        fold_events(events)
        .withColumn("head", F.when(trained, F.concat(head, F.lit(t.loss))).otherwise(head))
        .withColumn("body", escape(F.col("text")))
        .withColumn("tail", F.lit(t.end_turn))
        .withColumn("tail", F.when(trained, F.concat(F.lit(t.end_loss), "tail")).otherwise(F.col("tail")))
        .withColumn("trained", trained)
    )
    length = F.length("head") + F.length("body") + F.length("tail")
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start").alias("start"), F.length("body").cast("bigint").alias("length"))
    return (
        turns.groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            F.array_sort(F.collect_list(F.struct("position", F.concat("head", "body", "tail").alias("turn")))).alias("turns"),
            F.array_sort(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"),
        )
        .select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), "loss_spans")
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``turns`` (role, text as they were) and ``loss_text`` (all under the loss mask, unescaped), both from ``formatted`` alone."""
    t = template
    parts = F.split("formatted", _literal(t.end_turn), -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        inner = F.substring(x, F.lit(len(t.turn) + 1), F.length(x))
        role = F.substring_index(inner, t.after_role, 1)
        text = F.substring(inner, F.length(role) + len(t.after_role) + 1, F.length(inner))
        text = F.replace(F.replace(text, F.lit(t.loss), F.lit("")), F.lit(t.end_loss), F.lit(""))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    masked = F.split("formatted", _literal(t.loss), -1)
    masked = F.transform(F.slice(masked, 2, F.size(masked)), lambda x: F.substring_index(x, t.end_loss, 1))
    return formatted.withColumn("turns", F.transform(bodies, turn)).withColumn("loss_text", unescape(F.array_join(masked, "")))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
