"""Token counts of whole texts, huge ones by overlapping chunks spliced at stable boundaries.

A boundary is stable where a blank follows another character: no piece of the vocabulary has a
blank after another character (proved over all pieces when the model is loaded), so no merge
crosses it, and what lies on either side is divided alike whatever surrounds it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import id_field, in_tasks, slices, text_of

_BLANK = "▁"


class Counter:
    def __init__(self, model: str, chunk: int = 50_000, overlap: int = 400) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.stable = not any(re.search(f"[^{_BLANK}]{_BLANK}", x) for x in pieces) and self._plain()

    def _plain(self) -> bool:
        """Text is taken as it is, one blank set before it: so a chunk may begin after a blank."""
        probe = f"  a  b {_BLANK}x"
        return self.model.decode(self.model.encode(probe)) == probe.replace(_BLANK, " ")

    def counts(self, texts: list[str]) -> list[int]:
        short = [x for x in texts if len(x) <= self.chunk or not self.stable]
        found = iter(self.model.encode(short, num_threads=1) if short else [])
        return [len(next(found)) if len(x) <= self.chunk or not self.stable else self.spliced(x) for x in texts]

    def _starts(self, text: str, start: int, stop: int) -> list[int]:
        """Where the tokens of a chunk begin in the text. The blank before it is the one the model sets."""
        shift = start + 1 if start else 0
        found = self.model.encode(text[shift:stop], return_type="offset_mapping")["offsets"]
        return [start if i == 0 else shift + begin for i, (begin, _) in enumerate(found)]

    def spliced(self, text: str) -> int:
        """Tokens of the whole text. A chunk counts up to the boundary that it shares with the next."""
        total, begin, stop = 0, 0, self.chunk
        starts = self._starts(text, 0, stop)
        while stop < len(text):
            overlap, cut = self.overlap, None
            while cut is None and stop < len(text):
                cut = self._boundary(text, stop - overlap, stop)
                if cut is not None and cut <= begin:
                    cut = None
                if cut is None:  # no place to splice: a wider overlap
                    overlap *= 2
                    stop = min(len(text), stop + overlap)
                    overlap = min(overlap, stop - begin - 1)
                    starts = self._starts(text, begin, stop)
            if cut is None:
                break
            after = min(len(text), cut + self.chunk)
            following = self._starts(text, cut, after)
            if cut not in starts or following[:1] != [cut]:  # cannot be, by the proof
                return len(self.model.encode(text))
            total += starts.index(cut)
            begin, stop, starts = cut, after, following
        return total + len(starts)

    @staticmethod
    def _boundary(text: str, low: int, high: int) -> int | None:
        """The first stable boundary of the overlap, away from the chunk's end."""
        for found in re.finditer(rf"(?<=[^ {_BLANK}]) ", text[max(low, 0) : high - 1]):
            return max(low, 0) + found.start()
        return None


@functools.cache
def _counter(model: str, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def _counted(
    batches: Iterator[pa.RecordBatch], names: list[str], model: str, chunk: int, overlap: int
) -> Iterator[pa.RecordBatch]:
    counter = _counter(model, chunk, overlap)
    for part, texts in slices(batches):
        sizes = pa.compute.binary_length(part.column(1)).cast(pa.int64())
        found = pa.array(counter.counts(texts), pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), sizes, found], names=names)


def count_tokens(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk: int = 50_000,
    overlap: int = 400,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit (n_tokens above ``limit``).

    Texts up to ``chunk`` characters are encoded at once; longer ones in chunks, so that a task
    holds the tokens of one chunk. Both give what the library gives for the whole text. A model that
    lacks the proof, or text without a stable boundary, is encoded whole.

    Null or empty text: 0 bytes and tokens. Repeated rows: one result each. Empty table: no rows.
    """
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    run = in_tasks(_counted, schema.names, model, chunk, overlap)
    found = docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
