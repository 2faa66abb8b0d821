"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import math

import pandas as pd


def rows(pdf: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) or x is pd.NA:
            return None
        if isinstance(x, float):
            return round(x, 6)
        return x.item() if hasattr(x, "item") else x

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(x) for x in r) for r in pdf.astype(object).itertuples(index=False)), key=str)


def close(a, b) -> bool:
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) < 2e-6)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    x, y = rows(got), rows(want)
    assert len(x) == len(y)
    assert all(close(a, b) for p, q in zip(x, y, strict=True) for a, b in zip(p, q, strict=True)), next((p, q) for p, q in zip(x, y, strict=True) if p != q)
