"""Every registered query of the asset operators against its SQL."""

import pytest

from assetflow.plans import catalog, catalog_builds  # noqa: F401  registers


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_imports_without_training_operators(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("assetflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    try:
        assert set(entry.queries()) == set(catalog.QUERIES)
        assert set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        sys.modules.pop("__spark_entry__", None)
