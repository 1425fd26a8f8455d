import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup
from tests.llm.frames import AWKWARD, frame


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep, left = (min(known) if known else None), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left == 1))
            left -= i == keep
    return sorted(out, key=str)


def rows_of_size(n):
    r = random.Random(3)
    return AWKWARD + [(i, "hot copy" if i % 3 else f"text {r.randrange(40)}", "en", "a") for i in range(20, 20 + n)]


@pytest.mark.parametrize("salts", [1, 8])
@pytest.mark.parametrize(
    "digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1), lambda t: F.lit("same")]
)
def test_groups(spark, salts, digest):
    rows = rows_of_size(120)
    found = exact_dedup.find_copies(frame(spark, rows).repartition(5), salts=salts, digest=digest)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in found.collect()), key=str) == brute(rows)


def test_digest_is_of_the_normalised_text(spark):
    found = exact_dedup.find_copies(frame(spark, [(1, "a\t\n b")])).first()
    assert found["digest"] == hashlib.sha256(b"a b").hexdigest()


def test_rows_kept_have_all_columns(spark):
    rows = rows_of_size(60)
    docs = frame(spark, rows)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in left.collect())) == sorted(str(x[0]) for x in brute(rows) if x[3])


def test_empty_table(spark):
    assert exact_dedup.find_copies(frame(spark, [])).count() == 0
    assert exact_dedup.without_copies(frame(spark, [])).count() == 0
