"""Compares a Spark result with rows of DuckDB, whatever the order of rows and columns."""

import datetime
import decimal
import math


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


def same(df, duck, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
    assert len(got[1]) == len(want[1]) and not bad, (len(got[1]), len(want[1]), bad)
    return len(got[1])
