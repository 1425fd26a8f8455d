"""The entry module without the subpackage of training-data operators."""

import importlib
import sys


def test_other_queries_stand_without_the_subpackage(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    everything = set(entry.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    rest = set(importlib.reload(entry).queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert "sofa_sliding" in rest and not any(n.startswith("op") and n[2].isdigit() for n in rest)
    assert rest <= everything and set(entry.oracle_sql()) <= everything
