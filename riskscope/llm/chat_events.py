"""Chat formatting from an event log, in DataFrame operations only.

A conversation is a log of events: `delta` adds text to a message, `edit` replaces its text,
`regenerate` throws away the message and everything after it that came before the event. The
log is partitioned by conversation and folded by sequence into final messages, which are
rendered with a template and a loss mask over the assistant's texts.

The events of one message are folded together; messages of a conversation meet only to be
numbered, placed and joined to the formatted text, which is one value of the result.

Texts are escaped, so no text can imitate a mark, and the escape is reversed exactly:
`&` `<` `[` become references. A formatted turn is `<|turn:ROLE|>` newline TEXT `<|end|>` newline.

Defined cases: a null text is empty and a null role is the empty role; events of equal
sequence are ordered by kind and text; null conversation ids form one conversation; a message
whose events were all thrown away does not appear; further columns are not read; no events
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The escapes, in the order in which they are applied.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
TURN = r"<\|turn:([^|]*)\|>\n([^<]*)<\|end\|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of (conv_id, seq, message, role, kind, text) events."""
    rows = events.select(
        "conv_id",
        "message",
        F.struct(
            "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role"
        ).alias("e"),
    )
    last = lambda kind: F.max(F.when(F.col("e.kind") == kind, F.col("e.seq")))
    messages = rows.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list("e")).alias("log"), last("edit").alias("__edit"), last("regenerate").alias("__again")
    )
    upto = Window.partitionBy("conv_id").orderBy("message")
    reset = F.greatest("__edit", F.max("__again").over(upto))
    alive = F.filter("log", lambda e: (F.col("__reset").isNull() | (e["seq"] >= F.col("__reset"))) & (e["kind"] != "regenerate"))
    return (
        messages.withColumn("__reset", reset)
        .withColumn("__alive", alive)
        .where(F.size("__alive") > 0)
        .select(
            "conv_id",
            "message",
            F.coalesce(F.element_at("__alive", 1)["role"], F.lit("")).alias("role"),
            F.array_join(F.transform("__alive", lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_mask): the mask lists (start, length) in code points, from 0."""
    head = F.concat(F.lit("<|turn:"), escape(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "message", "role", head.alias("head"), body.alias("body"), F.concat(head, body, F.lit("<|end|>\n")).alias("turn")
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(earlier), F.lit(0)) + F.length("head")
    placed = turns.select(
        "conv_id",
        F.struct(
            "message",
            "turn",
            F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")).alias("span"),
            (F.col("role") == trained_role).alias("trained"),
        ).alias("t"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["trained"]), lambda t: t["span"]).alias("loss_mask"),
    )


def format_events(events: DataFrame) -> DataFrame:
    """One formatted conversation per conv_id, with its loss mask."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), parsed from the formatted text and its mask alone."""
    text = F.col("formatted")
    part = lambda group: F.regexp_extract_all(text, F.lit(TURN), F.lit(group))
    turns = F.zip_with(
        part(1), part(2), lambda role, body: F.struct(unescape(role).alias("role"), unescape(body).alias("text"))
    )
    masked = F.transform(
        "loss_mask", lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select(
        "conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length(text).cast("long").alias("formatted_chars")
    )


def stream_events(rows: DataFrame) -> DataFrame:
    """The events of stored turns (conv_id, turn, role, text): an assistant's text arrives in two deltas.

    Messages are numbered by turn, and turns of equal number by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select(
        "conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("message")
    )
    half = F.floor(F.length("text") / 2).cast("int")
    delta = lambda i, text: F.struct((2 * F.col("message") + i).alias("seq"), F.lit("delta").alias("kind"), text.alias("text"))
    whole = F.array(delta(0, F.col("text")))
    parts = F.array(
        delta(0, F.substring(F.col("text"), F.lit(1), half)),
        delta(1, F.substring(F.col("text"), half + 1, F.length("text"))),
    )
    events = F.when(F.col("role") == TRAINED_ROLE, parts).otherwise(whole)
    return numbered.select("conv_id", "message", "role", F.explode(events).alias("e")).select(
        "conv_id", "e.seq", "message", "role", "e.kind", "e.text"
    )
