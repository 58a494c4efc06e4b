"""Every registered batch and stream query against its DuckDB twin on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tallywright.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def twin(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, float | decimal.Decimal | int):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, twin, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        found = twin.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_works_without_the_llm_folder(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("tallywright.llm") or k == "corpus_pipeline"}
    monkeypatch.setitem(sys.modules, "tallywright.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(__spark_entry__)
    assert set(again.queries()) == set(QUERIES)
    monkeypatch.undo()
    sys.modules.update(held)
    importlib.reload(__spark_entry__)
