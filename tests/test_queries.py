"""Every query of the catalog runs; those with SQL equal DuckDB's result."""

import inspect
import math

import pytest

import __spark_entry__
from wayfare.operators import partitioning
from wayfare.queries import CATALOG
from wayfare.sql import ORACLES


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, duck, data, name):
    df, sql = CATALOG[name](spark, data), ORACLES.get(name)
    if name == "od_tensor_dense":  # two million cells, nearly all zero: these are counted, the others compared
        assert df.count() == duck.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]
        df, sql = df.where("y_total > 0"), f"SELECT * FROM ({sql}) WHERE y_total > 0"
    columns = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [tuple(_norm(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    assert _sorted(got) == _sorted(want)


def test_regularized_search_has_five_passes(spark, data, monkeypatch):
    search, asked = partitioning.search, []
    monkeypatch.setattr(partitioning, "search", lambda *a, **k: asked.append((a[3].count(), a[2].select("algorithm").distinct().count(), k)) or search(*a, **k))
    CATALOG["regularized_search"](spark, data)
    assert asked == [(16, 3, {})] and inspect.signature(search).parameters["passes"].default == 5


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(CATALOG) <= set(__spark_entry__.queries())
