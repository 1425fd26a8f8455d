"""Cost-balanced packing of documents into sequences of tokens.

A sequence costs ``linear * length + quadratic * length ** 2`` summed over its pieces, as attention
within each document does. Documents are taken in descending length, each goes to the sequence of
the lowest cost that still has room for it. What fits nowhere is cut to fill the gaps.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseflow.llm.common import id_field, in_tasks, slices, text_of

END_ID = 1
CHUNK_CHARS = 1_000_000
# A cut between a character that is no white space and a blank divides no token: no alternative of
# the vocabulary's split pattern goes on from other characters into white space.
_SAFE_CUT = re.compile(r"(?<=\S) ")


class Encoder:
    """Token ids as the tokenizers library gives them, without added special tokens.

    The same vocabulary exists as ranks for tiktoken, which is four times as fast. It is used where
    both must agree: text of Latin letters, whose classes no Unicode version has changed. Any other
    text, and text without a place to cut it, goes to the tokenizers library itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.special = [x.content for x in self.slow.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        parts = [self._part(x) for x in self._cut(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _cut(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK_CHARS:
            found = _SAFE_CUT.search(text, start + CHUNK_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def _part(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace")
        latin = not raw or np.frombuffer(raw, np.uint8).max() < 0xC9  # below U+0240
        if latin and len(text) <= 2 * CHUNK_CHARS and not any(x in text for x in self.special):
            if "          " not in text or not re.search(r"\s{1000}", text):
                return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.cache
def _encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(vocabulary, ranks, pattern)


class _Packer:
    """Packs one task's documents, a buffer of ``group`` sequences at a time."""

    def __init__(self, size: int, group: int, linear: float, quadratic: float, first: int) -> None:
        self.size, self.group, self.first = size, group, first
        self.linear, self.quadratic = linear, quadratic
        self.held: list[tuple[int, int, np.ndarray]] = []  # document, start, ids
        self.tokens = self.made = 0
        self.out: list[tuple[int, int, np.ndarray, int, int]] = []

    def _new(self) -> int:
        self.made += 1
        return self.first + self.made - 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for start in range(0, whole, self.size):
            self.out.append((doc, start, ids[start : start + self.size], self._new(), 0))
        if whole < len(ids):
            self.held.append((doc, whole, ids[whole:]))
            self.tokens += len(ids) - whole
        if self.tokens >= self.group * self.size:
            self.flush()

    def flush(self) -> None:
        """Fill as many whole sequences as the held tokens give; keep the rest."""
        n = self.tokens // self.size
        if not n:
            return
        free, cost = np.full(n, self.size), np.zeros(n)
        numbers = [self._new() for _ in range(n)]
        loose = []
        for doc, start, ids in sorted(self.held, key=lambda x: -len(x[2])):
            room = np.flatnonzero(free >= len(ids))
            if len(room):
                self._put(room[np.argmin(cost[room])], doc, start, ids, free, cost, numbers)
            else:
                loose.append((doc, start, ids))
        for at in np.argsort(cost, kind="stable"):
            while free[at]:
                doc, start, ids = loose.pop(0)
                if len(ids) > free[at]:
                    loose.insert(0, (doc, start + int(free[at]), ids[free[at] :]))
                self._put(at, doc, start, ids[: free[at]], free, cost, numbers)
        self.held, self.tokens = loose, sum(len(x[2]) for x in loose)

    def _put(self, at, doc, start, ids, free, cost, numbers) -> None:
        self.out.append((doc, start, ids, numbers[at], self.size - int(free[at])))
        free[at] -= len(ids)
        cost[at] += self.linear * len(ids) + self.quadratic * len(ids) ** 2

    def close(self) -> None:
        """The last tokens, under one sequence: sequences of powers of two, which need no padding."""
        self.flush()
        left = self.held
        for power in reversed(range(self.tokens.bit_length())):
            room = 1 << power
            if not self.tokens & room:
                continue
            number, offset = self._new(), 0
            while offset < room:
                doc, start, ids = left.pop(0)
                take = min(len(ids), room - offset)
                if take < len(ids):
                    left.insert(0, (doc, start + take, ids[take:]))
                self.out.append((doc, start, ids[:take], number, offset))
                offset += take
        self.held, self.tokens = [], 0


def _packed(
    batches: Iterator[pa.RecordBatch], names: list[str], files: tuple[str, str, str], how: tuple[int, int, float, float]
) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(*files)
    base = TaskContext.get().partitionId() << 32
    packer = _Packer(*how, base)
    keys: dict[int, tuple[object, int]] = {}  # of documents not yet wholly given out
    row, kind = 0, None

    def given() -> pa.RecordBatch:
        out, packer.out = packer.out, []
        known = [keys[x[0]] for x in out]
        waiting = {x[0] for x in packer.held}
        for doc in [x for x in keys if x not in waiting]:
            del keys[doc]
        columns = [
            pa.array([x[0] for x in known], kind),
            pa.array([x[1] for x in out], pa.int64()),
            pa.array([len(x[2]) for x in out], pa.int64()),
            pa.array([x[1] for x in known], pa.int64()),
            pa.array([x[3] for x in out], pa.int64()),
            pa.array([x[4] for x in out], pa.int64()),
            pa.array([x[2].astype("<u4").tobytes() for x in out], pa.binary()),
            pa.array([base + x[0] for x in out], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for part, texts in slices(batches):
        kind = part.schema.field(0).type
        for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
            ids = encoder.ids(text)
            ids = np.append(ids, np.uint32(END_ID))
            keys[row] = (key, len(ids))
            packer.add(row, ids)
            row += 1
        if packer.out:
            yield given()
    packer.close()
    if packer.out:
        yield given()


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    group: int = 256,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
) -> DataFrame:
    """Pieces of documents with their sequence: doc_id, start, length, doc_tokens, sequence_id, offset, ids, row.

    ``row`` numbers the rows of ``docs``, so that copies of a document are told apart. A document is its token ids and the end id; ``ids`` are a piece's, as little-endian unsigned
    32-bit numbers. Documents of ``size`` tokens and more give whole sequences and a rest; rests are
    packed in buffers of ``group`` sequences, each filled to the last token. Only the last tokens of
    a task, fewer than one sequence, go to sequences whose lengths are powers of two.

    Nothing is shuffled: a task packs the rows it reads, holding one buffer and one document. The
    numbers of its sequences begin with the number of its partition, so a task that is run again
    over the same rows gives the same sequences.

    Null or empty text: the end id alone. Repeated rows and equal ids: packed once per row. A null
    id stays null. Empty table: no rows. Ties in length keep the order of reading.
    """
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("row", T.LongType()),
        ]
    )

    run = in_tasks(_packed, schema.names, (vocabulary, ranks, pattern), (size, group, linear, quadratic))
    return docs.select(docs[id_col].alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
