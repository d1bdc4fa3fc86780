"""Chat formatting by event sourcing: fold logged events into final messages, then render them with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    r"""Text without a mark: each ``<``, any number of ``\``, ``|`` gets one more ``\``. Undone by :func:`unescaped`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    """A role on one line: a line feed becomes the mark ``<|n|>``, which escaped text cannot hold."""
    return F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("<|n|>"))


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the log of events that leads to it.

    Each turn is a message event with its role and two deltas, the halves of its text. Rows that repeat a turn
    are messages of their own, by role and text; null turns come first, null texts are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(order).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    none = F.lit(None).cast("string")
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("message").alias("type"), F.col("role").alias("role"), none.alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("type"), none.alias("role"), F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("type"), none.alias("role"), F.substring("text", half + 1, F.length("text")).alias("text")),
    )
    return numbered.select("conv_id", "message", F.explode(steps).alias("e")).select("conv_id", (F.col("message") * 3 + F.col("e.step")).alias("seq"), "message", "e.type", "e.role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, message, role, text, for events (conv_id, seq, message, type, role, text).

    Types: ``message`` starts a message with a role and a first text; ``delta`` appends; ``edit`` replaces the text;
    ``regenerate`` empties it for new deltas. An edit or a regeneration also drops the messages after it (larger
    number) that had started before. Other types are ignored. Texts are folded from the last event that sets
    them; the role is the last one given. Ties of seq go by type and text; null texts are empty; a null conv_id or
    message is a group of its own. Each message is folded by itself before a conversation is gathered.
    """
    setting = F.col("type").isin("message", "edit", "regenerate")
    known = events.filter(setting | (F.col("type") == "delta")).select("conv_id", "seq", "message", "type", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = F.sort_array(F.collect_list(F.struct("seq", "type", "role", "text")))
    messages = known.groupBy("conv_id", "message").agg(own.alias("events"))
    sets = F.filter("events", lambda e: e["type"] != "delta")
    # place of the last event that sets the text; 0 if there is none
    last = F.coalesce(F.array_max(F.filter(F.transform("events", lambda e, i: F.when(e["type"] != "delta", i + 1)), lambda i: i.isNotNull())), F.lit(1))
    revised = F.array_max(F.transform(F.filter("events", lambda e: e["type"].isin("edit", "regenerate")), lambda e: e["seq"]))
    folded = messages.withColumn("last", last).select(
        "conv_id",
        "message",
        F.try_element_at(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(-1)).alias("role"),
        F.concat_ws("", F.transform(F.slice("events", F.col("last"), F.size("events")), lambda e: F.when(e["type"] == "regenerate", F.lit("")).otherwise(e["text"]))).alias("text"),
        F.coalesce(F.array_max(F.transform(sets, lambda e: e["seq"])), F.col("events")[0]["seq"]).alias("started"),
        revised.alias("revised"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    kept = folded.withColumn("cut", F.max("revised").over(before)).filter("cut is null or started > cut")
    return kept.select("conv_id", "message", "role", "text")


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted string, mask array<struct<start, n>>.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with its text escaped. The mask names the texts to learn from,
    those of the roles ``learn``, by first byte and number of bytes in the UTF-8 form of ``formatted``; running
    sums give the places, so the work is linear in a conversation. The whole of a conversation is one string, as the
    format asks; no more than its rendered turns meet in one task.
    """
    role, text = _role(F.col("role")), escaped(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", "message", F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"), F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("learn"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("turn")).over(before), F.lit(0)) + F.octet_length("head")
    turns = turns.withColumn("start", at.cast("long")).withColumn("n", F.octet_length("body").cast("long"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "turn", "learn", "start", "n"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["n"].alias("n")))
    return gathered.select("conv_id", F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"), spans.alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, learned array<string> (texts under the mask), parsed from the format alone."""
    pieces = F.split(F.col("formatted"), F.lit("<\\|im_end\\|>\n"), -1)
    body = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    turn = lambda b: F.struct(
        unescaped(F.replace(F.substring_index(b, "\n", 1), F.lit("<|n|>"), F.lit("\n"))).alias("role"),
        unescaped(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text"),
    )
    raw = F.col("formatted").cast("binary")
    learned = F.transform("mask", lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["n"].cast("int")).cast("string")))
    return rendered.select("conv_id", "formatted", F.transform(body, turn).alias("turns"), learned.alias("learned"))


def format_chats(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold a log of events and render its conversations; see :func:`fold_events` and :func:`render`."""
    return render(fold_events(events), learn)
