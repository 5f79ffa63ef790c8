"""Comparing a Spark result with DuckDB's, without regard to order."""

import datetime
import math

import numpy as np
import pandas as pd


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool | np.bool_):
            return str(bool(x))
        if isinstance(x, int | float | np.number):
            return f"{float(x):.5g}" if abs(x) > 1e-9 else "0"
        if isinstance(x, datetime.date | datetime.datetime | pd.Timestamp | np.datetime64):
            return str(pd.Timestamp(x))
        return str(x)

    columns = sorted(df.columns)
    return sorted(zip(*(map(cell, df[c].astype(object)) for c in columns), strict=True))


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = canonical(ours), canonical(theirs)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, (sorted(ours.columns), different[:3])
