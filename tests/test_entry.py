"""The driver's entry points, with and without the training-data operators."""

import importlib.util
import re

import __spark_entry__ as entry


def test_names():
    names = set(entry.queries())
    assert {"o_j1_status", "o_j8_garbage", "o_j13_merge", "o_s6_revision"} <= names
    if importlib.util.find_spec("stowage.llm"):
        assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
        assert "pipeline" in names


def test_without_the_training_data_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("stowage.llm", "corpus_pipeline") else find(name, *a))
    assert not [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert not [n for n in entry.oracle_sql() if n.startswith("op")]
    assert len(entry.queries()) > 80
