"""Chat formatting from event logs: fold each message's events, order the messages, render a template."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TAIL = f"{END}\n"
#: Events that replace what a message said before; a delta adds to it; a delete removes the message.
RESETS = ("message", "edit", "regenerate")


def fold_events(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text): the final messages of an event log.

    Events are (conv, seq, kind, turn, role, text). Within a message, in the
    order of seq (ties: by kind, role, then text), ``message``, ``edit`` and
    ``regenerate`` set its text, ``delta`` adds to it, and ``delete`` removes it
    until a later event sets it again. A message's role is the last that an
    event names. Null text is empty and a null kind is a delta; other kinds
    raise an error. Null turns are one message, before the others.

    Each message folds by itself, so one conversation with a third of all
    events is spread over its messages.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    known = F.when(kind.isin("delta", "delete", *RESETS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), kind)))
    event = F.struct("seq", known.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy(F.col(conv).alias("conv"), "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # The last event that sets or removes the text, and those after it.
    last = F.expr(f"coalesce(array_max(transform(log, (e, i) -> if(e.kind IN {(*RESETS, 'delete')}, i, null))), 0)")
    live = F.slice("log", last + 1, F.size("log"))
    said = F.array_join(F.transform(F.filter(live, lambda e: e["kind"] != "delete"), lambda e: e["text"]), "")
    role = F.try_element_at(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != ""), F.lit(-1))
    removed = (F.size(live) == 1) & (F.element_at(live, 1)["kind"] == "delete")
    return grouped.where(~removed).select("conv", "turn", F.coalesce(role, F.lit("")).alias("role"), said.alias("text"))


def escape(text: str) -> str:
    r"""Reversible: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    r"""As texts, and a line break becomes ``\n``, since roles end with the line."""
    return escape(role).replace("\n", "\\n")


UNESCAPE = re.compile(r"\\([\\|n])")


def unescape(text: str) -> str:
    r"""The reverse of both: ``\\``, ``\|`` and ``\n`` (in roles only) are all that a backslash begins."""
    return UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(messages: DataFrame) -> DataFrame:
    """(conv, n_turns, formatted, loss): each conversation in one string, and where its loss applies.

    A message is ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and
    a line break. loss lists (start, end) in code points: the texts of the
    assistant's messages, in order; empty ones have empty spans. Messages are
    ordered by turn (null first), then role, then text.
    """
    by_conv = messages.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    conv_type = by_conv.schema["conv"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, loss, n_turns = [], [], []
            for turns in batch.column(1).to_pylist():
                parts, spans, at = [], [], 0
                for turn in turns:
                    role, body = turn["role"] or "", escape(turn["text"] or "")
                    head = f"{START}{escape_role(role)}\n"
                    if role == "assistant":
                        spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
                    parts += [head, body, TAIL]
                    at += len(head) + len(body) + len(TAIL)
                formatted.append("".join(parts))
                loss.append(spans)
                n_turns.append(len(turns))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_turns, pa.int64()), pa.array(formatted, pa.string()), pa.array(loss, spans_type)], ["conv", "n_turns", "formatted", "loss"])

    return by_conv.mapInArrow(write, f"conv {conv_type}, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each message of a formatted conversation."""
    found = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        found.append((unescape(role), unescape(body.removesuffix(TAIL))))
    return found


def format_events(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The conversations of an event log (see fold_events), formatted (see render). No events, no rows."""
    return render(fold_events(events, conv))


def turns_as_events(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The event log in which rows (conv, turn, role, text) come about as in a live chat, five events each.

    A draft is streamed, then edited (or, by the assistant, regenerated), and the
    final text streams in three parts. Events have the conversation's sequence
    numbers but don't come in their order. Rows that repeat a turn are told apart.
    """
    said = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(said) / 3).cast("int")
    none = F.lit(None).cast("string")
    again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    steps = [
        (F.lit("message"), F.col("role"), F.lit("a draft that ")),
        (F.lit("delta"), none, F.lit("nobody keeps")),
        (again, none, F.left(said, third)),
        (F.lit("delta"), none, F.substring(said, third + 1, third)),
        (F.lit("delta"), none, F.substring(said, third * 2 + 1, F.length(said))),
    ]
    first = F.coalesce(F.col("turn"), F.lit(0)).cast("long") * len(steps)
    events = [F.struct((first + k).alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text")) for k, (kind, role, text) in enumerate(steps)]
    message = F.struct(F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("row"))
    rows = turns.select(F.col(conv).alias("conv"), message.alias("message"), F.array(*[events[k] for k in (3, 1, 4, 0, 2)]).alias("events"))
    return rows.select("conv", "message", F.explode("events").alias("e")).select(F.col("conv").alias(conv), "e.seq", "e.kind", F.col("message").alias("turn"), "e.role", "e.text")
