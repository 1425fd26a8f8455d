import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, values int"


def test_the_transform_is_orthogonal_and_ordered():
    for size in (1, 2, 4, 8, 32):
        matrix = vector_codes.hadamard(size)
        assert np.array_equal(matrix @ matrix.T, size * np.eye(size, dtype=int))
        changes = (matrix[:, 1:] != matrix[:, :-1]).sum(axis=1)
        assert list(changes) == list(range(size))


@given(st.integers(1, 9), st.integers(1, 12), st.sampled_from([2, 40, 2**20, 2**40, 2**61]), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_nearest_is_exact(width, entries, reach, seed):
    r = random.Random(seed)
    parts = [[r.randrange(-reach, reach) for _ in range(width)] for _ in range(30)]
    book = [[r.randrange(-reach, reach) for _ in range(width)] for _ in range(entries)]
    book += book[:2]  # ties
    index, distance = vector_codes.nearest(np.array(parts, np.int64), np.array(book, np.int64))
    for part, i, d in zip(parts, index, distance, strict=True):
        every = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        assert (int(d), int(i)) == min((x, n) for n, x in enumerate(every))


def brute(rows, parts, entries, rounds, scale=256):
    kept = [
        (i, [math.floor(scale * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return [], None
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(map(repr, [(*r, totals[r[1]]) for r in out])), hashlib.sha256(text.encode()).hexdigest()


def rows(count, width, seed=2):
    r = random.Random(seed)
    value = lambda: float(np.float32(r.gauss(0, 1)))
    out = [(r.randrange(count), [value() for _ in range(width)], r.choice([1, 1, 1, 2, None])) for _ in range(count)]
    out += out[:20]  # repeated rows
    out += [(None, [value() for _ in range(width)], 3)] * 2
    out += [(-5, None, 1), (-4, [None] + [0.5] * (width - 1), 1), (-3, [math.nan] + [0.5] * (width - 1), None)]
    out += [(-2, [math.inf] + [0.5] * (width - 1), 1), (-1, [-math.inf] * width, 1)]
    return out


@pytest.mark.parametrize(("width", "parts", "entries"), [(64, 16, 64), (12, 4, 5), (10, 2, 256), (3, 3, 1)])
def test_codes_are_brute_force_s(spark, width, parts, entries):
    table = rows(300, width)
    frame = spark.createDataFrame([(*r, "c", "e", 1) for r in table], SCHEMA).repartition(3)
    coded, books = vector_codes.compress(frame, parts=parts, entries=entries)
    found = vector_codes.with_label_error(coded)
    got = sorted(repr(tuple(r)) for r in found.select("vec_id", "label", "code", "error", "label_error").collect())
    want, digest = brute(table, parts, entries, 2)
    assert got == want and vector_codes.digest(books) == digest


def test_large_values_stay_exact(spark):
    r = random.Random(1)
    table = [(i, [float(np.float32(r.uniform(-2e5, 2e5))) for _ in range(8)], 1) for i in range(60)]
    frame = spark.createDataFrame([(*x, "c", "e", 1) for x in table], SCHEMA)
    coded, books = vector_codes.compress(frame, parts=2, entries=4)
    got = sorted(repr(tuple(x)) for x in vector_codes.with_label_error(coded).select("vec_id", "label", "code", "error", "label_error").collect())
    want, digest = brute(table, 2, 4, 2)
    assert got == want and vector_codes.digest(books) == digest


def test_no_vector(spark):
    frame = spark.createDataFrame([(1, None, 1, "c", "e", 1)], SCHEMA)
    coded, books = vector_codes.compress(frame)
    assert vector_codes.with_label_error(coded).count() == 0 and books == []
    coded, _ = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0


def test_unequal_parts_are_refused(spark):
    frame = spark.createDataFrame([(1, [1.0] * 10, 1, "c", "e", 1)], SCHEMA)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame, parts=4)
