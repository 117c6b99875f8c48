"""Comparison of two results as sorted rows of plain values."""

from __future__ import annotations

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, str | int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v.is_integer() else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def same(df, result) -> None:
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows_of(names, result.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, int | float) and isinstance(y, int | float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)
