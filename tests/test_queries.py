"""Every query against its SQL on the smallest tables; queries without SQL must run and keep a stable schema."""

from __future__ import annotations

import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarryline.queries import ORACLE_SQL, QUERIES, TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(v):
    """Values as Python's own, so that both engines' compare; numbers that are whole are integers."""
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and math.isnan(v)):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return _plain(float(v))
    if isinstance(v, int | float | np.number):
        return int(v) if float(v).is_integer() else float(v)
    return str(v)


def _same(a, b) -> bool:
    """Exact, but for the last digits of floating numbers, whose sums depend on the order."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, float) or isinstance(b, float):
        return isinstance(a, int | float) and isinstance(b, int | float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def _order(row: tuple) -> tuple:
    """Sorts by what is exact first, then by rounded floats."""
    return repr([None if isinstance(v, float) else v for v in row]), repr([round(v, 4) if isinstance(v, float) else None for v in row])


def _rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_plain, row)) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=_order)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    assert got.columns
    frame = got.toPandas()
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(frame.columns) == sorted(expected.columns)
        a, b = _rows(frame), _rows(expected)
        assert len(a) == len(b)
        assert [(x, y) for x, y in zip(a, b, strict=True) if not _same(x, y)] == []


def test_boxes_of_odd_items(spark, tmp_path):
    """Items whose first pieces hold line breaks, a dash or signs only, or that have one piece."""
    items = ["Was and.\nEdndsh.\nThat it", "was\nand more", "and edndsh", "was  and", "was", "... was", "a\u2013b was", "Was, and.", None]
    texts = ["It was and. Edndsh that was more and", "was\x0band was a\u2013b was\tand", None, ""]
    con = duckdb.connect()
    for name, key, rows in (("benchmark", "item_id", items), ("documents", "doc_id", texts)):
        pd.DataFrame({key: range(1, len(rows) + 1), "text": rows}).to_parquet(tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    a, b = _rows(QUERIES["l07_m04_boxes"](spark, str(tmp_path)).toPandas()), _rows(con.execute(ORACLE_SQL["l07_m04_boxes"]).df())
    assert len(b) > 2
    assert [(x, y) for x, y in zip(a, b, strict=True) if not _same(x, y)] == []


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
