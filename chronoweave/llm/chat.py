"""Chat formatting from event logs, in DataFrame functions only.

A conversation is a log of events: a message opens a version of a turn, deltas append to it, an edit puts
another text in its place, a regeneration starts it anew. Events are folded by sequence number into the final
message of each turn; turns are rendered through one template with a loss mask over assistant texts.

Template: ``<s>`` role newline text ``</s>`` for each turn. In roles and texts ``&``, ``<`` and ``[`` are
written as ``&amp;``, ``&lt;`` and ``&#91;``, and a newline in a role as ``&#10;``, so no text can hold a control
string, and reading back is exact.

Scale: one shuffle by conversation serves the fold and the rendering (partition by conv_id clusters both
groupings). A conversation must fit one row, since its rendering is one string; conversations spread evenly.

Defined cases: null text is empty; a null role is the empty role; events of null or unknown kind are deltas, and
deltas before any opening stand where they are, as if an empty message had opened the turn; a null seq comes before
all others; ties in seq go by text, so repeated rows repeat their delta; an empty log gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPENING = ("message", "edit", "regenerate")
BEGIN, END = "<s>", "</s>"
# What is written for the characters that begin control strings or escapes, in order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(x: Column) -> Column:
    for a, b in ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("&#10;"))


def unescape(x: Column) -> Column:
    for a, b in (("\n", "&#10;"), *reversed(ESCAPES)):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from (conv_id, seq, turn, kind, role, text)."""
    turn = Window.partitionBy("conv_id", "turn")
    opening = F.coalesce(F.col("kind").isin(*OPENING), F.lit(False))
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63)))
    log = events.select("conv_id", "turn", seq.alias("seq"), opening.alias("first"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    live = log.withColumn("_open", F.max(F.when(F.col("first"), F.col("seq"))).over(turn)).where("_open is null or seq >= _open")
    # at the opening event's number only the opening itself counts; of several, the last by text
    parts = live.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.struct(F.when(F.col("first"), 1).otherwise(0), "seq", "role")).alias("role"),
        F.max(F.when(F.col("first"), F.struct("seq", "text"))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("seq", "text")))).alias("deltas"),
    )
    text = F.concat(F.coalesce(F.col("base")["text"], F.lit("")), F.array_join(F.transform("deltas", lambda d: d["text"]), ""))
    return parts.select("conv_id", "turn", "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): the rendering and the [start, end) code points of assistant texts."""
    m = messages.select("conv_id", "turn", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.length("role") + len(BEGIN) + 1
    width = (head + F.length("text") + len(END)).cast("long")
    m = m.withColumn("at", F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    m = m.select("conv_id", "at", F.concat(F.lit(BEGIN), "role", F.lit("\n"), "text", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct((F.col("at") + head).cast("long").alias("start"), (F.col("at") + head + F.length("text")).cast("long").alias("end"))).alias("mine"))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("t"), F.array_sort(F.collect_list("mine")).alias("mask"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), "mask")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss: the unescaped texts under the mask, in order, formatted)."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    turn = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"))
    loss = F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return rendered.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss"), "formatted")


def as_events(conversations: DataFrame) -> DataFrame:
    """A plain table of turns as a log that folds to it; every row, by (turn, role, text), is a turn of its own.

    By a hash of the row its text arrives in one of three ways: as a message and two deltas; as a draft that an edit
    replaces; as a draft and a delta that a regeneration drops, with its own delta for the second half.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right, draft = F.left("text", half), F.substr("text", half + 1), F.left("text", F.lit(8))
    way = F.pmod(F.xxhash64("conv_id", "n"), F.lit(3))

    def log(*events):
        return F.array(*[F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(events)])

    streamed = log(("message", F.lit("")), ("delta", left), ("delta", right))
    edited = log(("message", draft), ("edit", F.col("text")))
    redone = log(("message", draft), ("delta", F.lit("...")), ("regenerate", left), ("delta", right))
    rows = rows.select("conv_id", "n", "role", F.inline(F.when(way == 0, streamed).when(way == 1, edited).otherwise(redone)))
    return rows.select("conv_id", (F.col("n") * 4 + F.col("step")).alias("seq"), F.col("n").alias("turn"), "kind", "role", "text")


def format_report(conversations: DataFrame) -> DataFrame:
    """Digests of what is read back from the rendering of (conv_id, turn, role, text)."""
    back = read_back(render(fold_events(as_events(conversations))))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
