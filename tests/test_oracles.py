"""Every query with a DuckDB counterpart gives the same rows as that."""

from __future__ import annotations

import math

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, float):
            return repr(round(v, 8) + 0.0)
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    mine, theirs = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    for c in mine.columns:  # whole numbers that may be null come as floats
        if mine[c].dtype.kind == "f" and theirs[c].dtype.kind in "iu" or str(theirs[c].dtype) == "Int64":
            mine[c], theirs[c] = mine[c].astype(float), theirs[c].astype(float)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "doc", "score", "rank"] and df.count() == 400
