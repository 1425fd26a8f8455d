"""What the operators of this subpackage share.

Every operator names the columns it reads, so further columns may have any name. Nulls count as
empty text. Row order never matters.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A run of white space, and a word.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Characters of text a Python task works on at once.
SLICE_CHARS = 2_000_000


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def id_field(docs: DataFrame, id_col: str) -> T.StructField:
    return T.StructField("doc_id", docs.schema[id_col].dataType)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def in_tasks(function: Callable, *arguments) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function(batches, *arguments)`` for mapInArrow; tasks import its module, from here if it is not installed."""
    module, name = function.__module__, function.__name__
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, *arguments)

    return run


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with their texts, of about ``SLICE_CHARS`` characters (one row may hold more)."""
    for batch in batches:
        sizes = pa.compute.utf8_length(batch.column(text_at)).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            held += size or 0
            if held >= SLICE_CHARS or row + 1 == len(sizes):
                part = batch.slice(start, row + 1 - start)
                yield part, [x or "" for x in part.column(text_at).to_pylist()]
                start, held = row + 1, 0
