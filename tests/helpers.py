"""Small helpers shared by the tests."""

from __future__ import annotations

import datetime as dt


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days(start: str, n: int, step: int = 1) -> list[dt.date]:
    return [d(start) + dt.timedelta(days=i * step) for i in range(n)]


def rows(df, *cols):
    """Rows as a sorted list of tuples of the named columns."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=order)


def order(row):
    """Sort key that puts nulls first and dates in calendar order."""
    return [(v is not None, v.isoformat() if isinstance(v, dt.date) else repr(v)) for v in row]


def one(df):
    found = df.collect()
    assert len(found) == 1, found
    return found[0]
