import builtins
import importlib
import sys

import __spark_entry__ as entry_module


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).columns == ["group", "agg", "se"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_registry_without_the_llm_subpackage(monkeypatch):
    real = builtins.__import__

    def refuse(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    bare = importlib.reload(entry_module)
    try:
        assert bare.queries() and not any(n.startswith("op") or n == "pipeline" for n in bare.queries())
        assert not any(n.startswith("op") for n in bare.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry_module)
