"""Conversations as training text: a compiled template renders turns, marks what is trained on, and can be read back.

A row is a turn. Turns are dealt by conversation and slice of turns, so one conversation of any length is
rendered by many tasks; what a turn must know of the others (its place, whether it is the last) comes
with one small row per slice. A task holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import in_tasks, slices
from caseflow.llm.templates import compile_template, unescape, unheader

# Control strings that mark turns.
START = "<|im_start|>"
END = "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}"
    "{{ start }}{{ message.role | header }}{{ '\\n' }}"
    "{% if message.role == 'assistant' %}"
    "{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ end ~ '\\n' }}"
    "{% endfor %}"
)
# Turns of a conversation that one task renders in a row.
SLICE_TURNS = 1024
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def _rendered(batches: Iterator[pa.RecordBatch], names: list[str], source: str, constants: dict) -> Iterator[pa.RecordBatch]:
    template = compile_template(source, **constants)
    start = total = nth = 0
    for part, texts in slices(batches, 4):
        ids, places, pieces, spans = [], [], [], []
        columns = (part.column(i).to_pylist() for i in range(4))
        for row, (_, first, size, role) in enumerate(zip(*columns, strict=True)):
            if size is not None:  # the row of a slice stands before its turns
                start, total, nth = first, size, 0
                continue
            piece, found = template.message({"role": role, "text": texts[row]}, start + nth, start + nth + 1 == total)
            ids.append(row)
            places.append(start + nth)
            pieces.append(piece)
            spans.append([{"start": a, "stop": b} for a, b in found])
            nth += 1
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int64()), pa.array(pieces, pa.large_string()).cast(pa.string()), pa.array(spans, kind)],
            names=names,
        )


def format_turns(
    turns: DataFrame,
    source: str = TEMPLATE,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    slice_turns: int = SLICE_TURNS,
    **constants: object,
) -> DataFrame:
    """One row per turn: conv_id, position (0, 1, ... in the conversation), piece, spans.

    A conversation's pieces in their order are its formatted text. ``spans`` are what the template marks
    as generation, in characters of the piece. Turns stand by turn number, nulls last, then by role and
    text; repeated rows are turns of their own. Null role and text are empty. Rows without a conversation
    id are one conversation. Empty table: no rows. ``constants`` are names the template may use.
    """
    constants = {"start": START, "end": END, **constants}
    compile_template(source, **constants)  # a faulty template fails here
    conv = T.StructField("conv_id", turns.schema[conv_col].dataType)
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        F.floor(turns[turn_col] / slice_turns).cast("long").alias("slice"),
        turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    counts = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    # one row for so many turns
    order = Window.partitionBy("conv_id").orderBy(F.col("slice").asc_nulls_last())
    heads = counts.select(
        "conv_id",
        "slice",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("size"),
    )
    both = rows.withColumns({"first": F.lit(None).cast("long"), "size": F.lit(None).cast("long")}).unionByName(
        heads, allowMissingColumns=True
    )
    dealt = both.repartition("conv_id", "slice").sortWithinPartitions(
        "conv_id", "slice", F.col("size").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "text"
    )
    schema = T.StructType(
        [conv, T.StructField("position", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("spans", _SPANS)]
    )
    return dealt.select("conv_id", "first", "size", "role", "text").mapInArrow(
        in_tasks(_rendered, schema.names, source, constants), schema
    )


def read_turns(piece: str) -> list[tuple[str, str]]:
    """The (role, text) of the turns in a piece of output of ``TEMPLATE``."""
    found, at = [], 0
    while at < len(piece):
        match = _TURN.match(piece, at)
        if not match:
            raise ValueError(f"no turn at character {at}")
        found.append((unheader(match[1]), unescape(match[2])))
        at = match.end()
    return found


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for part, pieces in slices(batches, 2):
        at, nth, roles, texts, losses, sizes = [], [], [], [], [], []
        for row, (piece, spans) in enumerate(zip(pieces, part.column(3).to_pylist(), strict=True)):
            loss = "".join(unescape(piece[s["start"] : s["stop"]]) for s in spans)
            for i, (role, text) in enumerate(read_turns(piece)):
                at.append(row)
                nth.append(i)
                roles.append(role)
                texts.append(text)
                # what belongs to the whole piece is told with its first turn
                losses.append(loss if i == 0 else "")
                sizes.append(len(piece) if i == 0 else 0)
        chosen = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).take(chosen),
                part.column(1).take(chosen),
                pa.array(nth, pa.int64()),
                *(pa.array(x, pa.string()) for x in (roles, texts, losses)),
                pa.array(sizes, pa.int64()),
            ],
            names=names,
        )


def read_back(pieces: DataFrame) -> DataFrame:
    """The turns in the output of ``TEMPLATE``: conv_id, position, nth, role, text, loss, piece_chars.

    ``loss`` is the unescaped text under the generation marks of the turn's piece. Each piece is read by itself.
    """
    schema = T.StructType(
        [
            pieces.schema["conv_id"],
            *(T.StructField(n, T.LongType()) for n in ("position", "nth")),
            *(T.StructField(n, T.StringType()) for n in ("role", "text", "loss")),
            T.StructField("piece_chars", T.LongType()),
        ]
    )
    return pieces.select("conv_id", "position", "piece", "spans").mapInArrow(in_tasks(_read, schema.names), schema)


class _Digest:
    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digested(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, open_ = None, None
    kind = None

    def out(ids, rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names
        )

    for part, texts in slices(batches, 2):
        kind = part.schema.field(0).type
        ids, rows = [], []
        columns = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
        for text, (conv, role, loss, size) in zip(texts, zip(*columns, strict=True), strict=True):
            if open_ is None or conv != held:
                if open_ is not None:
                    ids.append(held)
                    rows.append(open_.row())
                held, open_ = conv, _Digest()
            open_.turns += 1
            open_.all.update(f"{role}\n{text}\n".encode())
            open_.loss.update(loss.encode())
            open_.loss_chars += len(loss)
            open_.chars += size
        yield out(ids, rows)
    if open_ is not None:
        yield out([held], [open_.row()])


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation runs over it in order, by its nature in one task, which holds a turn
    at a time. Rendering and reading back are not bound to it.
    """
    schema = T.StructType(
        [
            read.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "position", "nth")
    return dealt.select("conv_id", "role", "text", "loss", "piece_chars").mapInArrow(in_tasks(_digested, schema.names), schema)
