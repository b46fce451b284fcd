"""The entry module works with and without the optional subpackage."""

import builtins
import importlib

import pytest

import __spark_entry__ as entry
from quarryset import catalog
from tests.oracle import ROOT


@pytest.mark.skipif(not ROOT.exists(), reason="no test data here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].vec_id == 0 and rows[0].score == 1.0


def test_queries_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def absent(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("quarryset.llm") or (name == "quarryset" and fromlist and "llm" in fromlist):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", absent)
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.SQL)


def test_core_never_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(importlib.import_module("quarryset").__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "quarryset.llm" not in f.read_text(), f
