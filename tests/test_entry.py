import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query_and_the_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_imports_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tapeflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tapeflow.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        importlib.reload(entry)
        names = set(entry.queries())
        assert "instrument_volumes" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
