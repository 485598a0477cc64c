"""The driver's contract."""

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query", "package_name", "edits", "place"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_the_tokenizers(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("namewarden.llm") or m in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    found = __spark_entry__.queries()
    assert "neighbors_flat_lev" in found and not any(k.startswith("op") for k in found)
