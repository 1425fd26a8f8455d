"""Vectors as short codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

Components are integers. Parts and entries are padded with zeros to a power of two and go through an
integer Walsh-Hadamard transform, which scales squared distances by the padded length and gathers what
parts differ by in the first coefficients. Squared differences are added up in sequency order; an entry
whose sum so far is above a whole distance already known is out. Sums of integers: no rounding anywhere.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.common import in_tasks
from caseflow.sources.sinks import staged

# Vectors a task works on at once.
BLOCK = 2048
_LARGEST = np.iinfo(np.int64).max


@functools.cache
def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, its rows in order of their sign changes."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    changes = (matrix[:, 1:] != matrix[:, :-1]).sum(axis=1)
    return matrix[np.argsort(changes)]


def transformed(parts: np.ndarray) -> np.ndarray:
    """The sequency-ordered coefficients of each row, padded with zeros to a power of two."""
    size = 1 << (parts.shape[1] - 1).bit_length()
    padded = np.zeros((len(parts), size), parts.dtype)
    padded[:, : parts.shape[1]] = parts
    return padded @ hadamard(size).astype(parts.dtype)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as 64-bit integers if no squared distance between them can leave that range, else as Python's."""
    reach = 2 * max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    size = 1 << (arrays[0].shape[1] - 1).bit_length()
    # a coefficient is at most size * reach, and size of them are squared and added
    kind = np.int64 if size * (size * reach) ** 2 <= _LARGEST else object
    return tuple(a.astype(kind) for a in arrays)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry, the lowest of equals, and the squared distance."""
    parts, entries = exact(parts, entries)
    a, b = transformed(parts), transformed(entries)
    size = a.shape[1]
    sums = (a[:, None, 0] - b[None, :, 0]) ** 2
    # a whole distance to start from: that of the entry with the least first term
    likely = np.argmin(sums, axis=1)
    best = ((a - b[likely]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    held = sums[row, entry]
    for k in range(1, size):
        held = held + (a[row, k] - b[entry, k]) ** 2
        left = held <= best[row]
        row, entry, held = row[left], entry[left], held[left]
    # rows ascend, and within a row entries ascend: the first of the least is the lowest index
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(held, starts) if len(held) else held
    chosen = np.flatnonzero(held == np.repeat(least, np.diff(np.concatenate((starts, [len(row)])))))
    first = chosen[np.concatenate(([True], row[chosen][1:] != row[chosen][:-1]))]
    return entry[first].astype(np.int64), held[first] // size


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their vectors of integers."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            values = part.column(at).flatten().to_numpy(zero_copy_only=False)
            yield part, values.reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch], codebooks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per part and entry, of this task's vectors: how many parts are nearest to it, and their sum."""
    parts, width = len(codebooks), codebooks[0].shape[1]
    count = [np.zeros(len(c), np.int64) for c in codebooks]
    total = [np.zeros(c.shape, object) for c in codebooks]
    for _, vectors in _blocks(batches, 0):
        for p in range(parts):
            own = vectors[:, p * width : (p + 1) * width]
            index, _ = nearest(own, codebooks[p])
            count[p] += np.bincount(index, minlength=len(codebooks[p]))
            order = np.argsort(index, kind="stable")
            used, starts = np.unique(index[order], return_index=True)
            # within a block sums of 64-bit integers hold, or the values are Python's
            (small,) = exact(own) if len(own) else (own,)
            total[p][used] += np.add.reduceat(small[order], starts, axis=0).astype(object)
    rows = [(p, e, int(count[p][e]), x, str(total[p][e, x])) for p in range(parts) for e in np.flatnonzero(count[p]) for x in range(width)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "entry", "n", "x", "total"]
    )


def _coded(batches: Iterator[pa.RecordBatch], names: list[str], codebooks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    width = codebooks[0].shape[1]
    for part, vectors in _blocks(batches, 2):
        codes = np.zeros((len(vectors), len(codebooks)), np.uint8)
        error = np.zeros(len(vectors), object)
        for p, entries in enumerate(codebooks):
            index, distance = nearest(vectors[:, p * width : (p + 1) * width], entries)
            codes[:, p] = index
            error += distance.astype(object)
        hexes = codes.tobytes().hex()
        step = 2 * codes.shape[1]
        code = [hexes[i : i + step] for i in range(0, len(hexes), step)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], names=names
        )


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, values: rows without nulls or non-finite components, each component floor(scale * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.filter(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled: Column = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return kept.select(kept[id_col].alias("vec_id"), kept[label_col].alias("label"), scaled.alias("values"))


def codebooks_of(numbers: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part position. What the driver holds is parts x entries x part length numbers."""
    if parts < 1 or not 1 <= entries <= 256:
        raise ValueError("at least one part, and 1 to 256 entries, whose index has two hex digits")
    first = numbers.select("vec_id", "values").orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries)
    start = np.array([r["values"] for r in first.collect()], np.int64)
    if not len(start):
        return []
    if start.shape[1] % parts or not start.shape[1]:
        raise ValueError(f"vectors of {start.shape[1]} components have no {parts} equal parts")
    width = start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        found = (
            numbers.select("values")
            .mapInArrow(in_tasks(_sums, books), "part int, entry int, n long, x int, total string")
            .groupBy("part", "entry", "x")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        )
        books = [b.copy() for b in books]
        for row in found.collect():
            books[row["part"]][row["entry"], row["x"]] = int(row["total"]) // row["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> tuple[DataFrame, list[np.ndarray]]:
    """One row per kept vector: vec_id, label, code, error (its squared distance); and the codebooks.

    Left out are rows whose vector is null or holds null or non-finite components. A codebook starts as the
    parts of the ``entries`` smallest ids (null ids last, equal ids by their components), or of all vectors,
    if there are fewer. In each of ``rounds`` rounds an entry becomes the floor of the mean of the parts that
    are nearest to it; ties go to the lower index; an entry without parts stays. Repeated rows count each.
    No kept vector: no rows and no codebooks. Vectors must be of one length that has so many equal parts;
    components and errors must fit into 64 bits, or the job fails.
    """
    numbers = whole_numbers(vectors, id_col, vector_col, label_col, scale)
    books = codebooks_of(numbers, parts, entries, rounds)
    names = ["vec_id", "label", "code", "error"]
    kinds = [numbers.schema["vec_id"].dataType, numbers.schema["label"].dataType, T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    if not books:
        return vectors.sparkSession.createDataFrame([], schema), books
    return numbers.mapInArrow(in_tasks(_coded, names, books), schema), books


def with_label_error(coded: DataFrame, salts: int = 16) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together.

    The sums combine in the tasks. They meet the rows under a salt, so the rows of one label are dealt over
    ``salts`` tasks where the sums are too many to be sent everywhere.
    """
    rows = staged(coded)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).alias("a")
    same = F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt"))
    return left.join(salted.alias("b"), same).select("a.*", "b.label_error").drop("salt")
