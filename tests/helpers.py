"""Shared by the tests: rows as sorted tuples, dates from day numbers."""

import datetime as dt


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def values(df, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
