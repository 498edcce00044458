"""Chat formatting from an event log, with DataFrame functions only.

A conversation is a log of events (conv_id, seq, turn, kind, role, text). The log is partitioned by conversation, ordered
by sequence number and folded into final messages, which are rendered into one training string with a loss mask.

kinds: ``open`` starts a turn and names its role; ``delta`` appends text; ``edit`` replaces what the turn holds so far;
``regenerate`` empties the turn and withdraws every later turn written before it; ``retract`` removes the turn.

Defined cases: a null text is empty; a null or unknown kind counts as ``delta``; the last non-null role of a turn holds,
without one the role is empty; equal sequence numbers are ordered by kind and text; rows with a null turn or a null
conversation form a turn (first in order) and a conversation of their own; repeated events count each time; an empty log
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<s>", "</s>"
#: Strings with a meaning in the template or in templates readers may apply; inside texts their first character is escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: First character of a control string, its escape letter, and what must follow.
_OPENERS = (("<", "l", r"<(?=s>|/s>|<SYS>>|</SYS>>)"), ("[", "b", r"\[(?=INST\]|/INST\])"))
_NAMES = {first: letter for first, letter, _ in _OPENERS}
KINDS = {"open": 0, "delta": 1, "edit": 2, "regenerate": 3, "retract": 4}


def escape(text: Column) -> Column:
    """Double every backslash, then write the first character of each control string as backslash and a letter."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for _, letter, pattern in _OPENERS:
        out = F.regexp_replace(out, pattern, "\\\\" + letter)
    return out


def unescape(text: Column, names: dict[str, str] = _NAMES) -> Column:
    """The exact inverse of ``escape``: split at doubled backslashes so that no escape is read across one."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: reduce(lambda c, kv: F.replace(c, F.lit("\\" + kv[1]), F.lit(kv[0])), names.items(), p))
    return F.array_join(plain, "\\")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log."""
    kind = F.coalesce(F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))]), F.coalesce(F.lower("kind"), F.lit("delta"))), F.lit(1))
    log = events.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), kind.alias("k"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last(), F.col("k").desc(), F.col("text").desc()).rowsBetween(Window.unboundedPreceding, -1)
    withdrawn = F.min(F.when(F.col("k") == 3, F.col("turn"))).over(later)
    log = log.withColumn("gone", F.coalesce(F.col("turn") > withdrawn, F.lit(False))).where("not gone")
    # what a turn holds starts at its last edit or regeneration
    order = F.struct(F.coalesce(F.col("seq"), F.lit(-(2**63))).alias("seq"), F.col("k").alias("k"), F.col("text").alias("text"))
    turns = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("k").isin(2, 3), order)).alias("reset"),
        F.max(F.when(F.col("k") == 4, order)).alias("dropped"),
        F.max_by("role", F.when(F.col("role").isNotNull(), order)).alias("role"),
        F.sort_array(F.collect_list(F.when(F.col("k").isin(0, 1, 2), order))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    return turns.where("dropped is null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss_spans`` (start, length in code points, start from 0).

    A turn reads: turn mark, escaped role, line feed, escaped text, end mark. The loss mask covers the escaped text of
    the trained roles. Line feeds in a role are written as the escape ``\\n`` of a role only.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    turns = messages.select("conv_id", "turn", role.alias("r"), escape(F.col("text")).alias("t"), F.col("role").isin(*trained_roles).alias("loss"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "r", "t", "loss"))).alias("turns"))
    pieces = F.transform("turns", lambda m: F.concat(F.lit(TURN), m["r"], F.lit("\n"), m["t"], F.lit(END)))
    sizes = F.transform("turns", lambda m: F.struct((F.length(m["r"]) + len(TURN) + 1).alias("head"), F.length(m["t"]).alias("body"), m["loss"].alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, m: F.struct(
        (acc["at"] + m["head"] + m["body"] + len(END)).alias("at"),
        F.when(m["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["head"]).alias("start"), m["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return conv.select("conv_id", F.array_join(pieces, "").alias("formatted"), F.aggregate(sizes, start, step)["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back from a rendered conversation."""
    chunks = F.filter(F.split(formatted, END, -1), lambda c: c != "")
    bodies = F.transform(chunks, lambda c: F.substring(c, len(TURN) + 1, 2**31 - 1))
    return F.transform(bodies, lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1), _NAMES | {"\n": "n"}).alias("role"),
        unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.lit(2**31 - 1))).alias("text"),
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversation_events(rows: DataFrame) -> DataFrame:
    """The log of a table of finished turns: each row opens its turn and streams its text as one delta."""
    seq = F.coalesce(F.col("turn"), F.lit(-1)) * 2
    both = F.explode(F.array(
        F.struct(F.lit("open").alias("kind"), seq.alias("seq"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct(F.lit("delta").alias("kind"), (seq + 1).alias("seq"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")),
    )).alias("e")
    return rows.select("conv_id", "turn", both).select("conv_id", "turn", "e.*")


def format_events(events: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(fold(events), trained_roles)
