"""The driver's contract: names agree, and the library stands without the training-data subpackage."""

import importlib
import sys

import __spark_entry__


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("docgraph.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("docgraph.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    hidden = Missing()
    sys.meta_path.insert(0, hidden)
    monkeypatch.delattr(sys.modules["docgraph"], "llm", raising=False)
    try:
        entry = importlib.reload(__spark_entry__)
        assert "sort_relations" in entry.queries()
        assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
    finally:
        sys.meta_path.remove(hidden)
        importlib.reload(__spark_entry__)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
