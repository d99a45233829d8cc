"""Chat formatting: conversations rendered by a compiled template, with a loss mask over the assistant.

A turn is ``### role``, a line end, the text and ``</turn>`` with a line end. Control strings inside
roles and texts are broken by a backslash, which ``unescape`` takes out again, so the output can be
read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template

# The control strings and the template that writes them.
TURN_START, TURN_END = "### ", "</turn>"
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}")
TURN = re.compile(r"### ((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """``text`` without control strings: a backslash before each backslash and inside each of them."""
    text = text.replace("\\", "\\\\")
    for control in (TURN_START, TURN_END):
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def escape_line(text: str) -> str:
    """As ``escape``, line ends too."""
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    """What ``escape`` or ``escape_line`` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def chat_renderer(template: str = TEMPLATE):
    """The function from a list of {role, text} to the formatted text and its generated spans."""
    render = compile_template(template, {"escape": escape, "line": escape_line})
    return lambda messages: render({"messages": messages})


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row a conversation: conv_id, formatted, spans (array of [start, end) in code points).

    Turns are taken in order of turn, then role, then text, nulls first; null role and null text count
    as empty, a null conv_id is a conversation of its own, repeated rows are repeated turns. Turns of
    one conversation meet in one task, as its text is one value; tasks hold one conversation at a time.
    Other columns are ignored; no rows give no conversations.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = chat_renderer(template)
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
        messages, current, ready, size = [], None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if messages and conv != current:
                    ready.append((current, *render(messages)))
                    size += len(ready[-1][1])
                    messages = []
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in ready], schema)
                        ready, size = [], 0
                current = conv
                messages.append({"role": role, "text": text})
        if messages:
            ready.append((current, *render(messages)))
        if ready:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in ready], schema)

    return rows.mapInArrow(run, "conv_id long, formatted string, spans array<array<int>>")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and of the text under the loss mask, read back from ``formatted``."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
