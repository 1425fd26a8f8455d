import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import token_counts
from tests.llm.frames import AWKWARD, frame, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def whole(text):
    return len(token_counts._counter(MODEL, 50_000, 400).model.encode(text))


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (97, 20), (300, 50)])
def test_spliced_counts_are_whole_ones(chunk, overlap):
    r = random.Random(14)
    counter = token_counts.Counter(MODEL, chunk, overlap)
    assert counter.stable
    for n in (0, 30, 300):
        text = prose(r, n).replace("mu", "  mu").replace("nu", "\n漢字🙂 ").replace("xi", "<s>▁ ▁x")
        assert counter.counts([text]) == [whole(text)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab  ▁\n.é漢<s>"), max_size=200))
def test_any_text(text):
    assert token_counts.Counter(MODEL, 20, 4).counts([text]) == [whole(text)]


def test_text_without_boundary_widens_to_the_whole():
    counter = token_counts.Counter(MODEL, 50, 10)
    for text in ("x" * 1000, " " * 1000, "a" * 70 + " " + "b" * 500):
        assert counter.counts([text]) == [whole(text)]


def test_rows(spark):
    rows = [*AWKWARD, (50, prose(random.Random(15), 3000), "en", "a")]
    found = token_counts.count_tokens(frame(spark, rows), MODEL, chunk=500, overlap=60).collect()
    want = sorted(((i is None, i or 0, len((t or "").encode()), whole(t or ""), whole(t or "") > 4096) for i, t, *_ in rows))
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in found) == want


def test_empty_table(spark):
    assert token_counts.count_tokens(frame(spark, []), MODEL).count() == 0
