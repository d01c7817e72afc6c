"""What the training-text part lacks inside is an error, not a reason to leave it out."""

import importlib
import sys

import pytest

import __spark_entry__


def test_missing_dependency_is_raised(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("lexigrove.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    assert "p1_found" in importlib.reload(__spark_entry__).queries()
