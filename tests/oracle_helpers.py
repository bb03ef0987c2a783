"""Rows of queries and of their SQL in one comparable form."""

import math
from collections import Counter

DATA = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(shown(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, text):
    found = con.execute(text)
    names = [x[0] for x in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, Counter(tuple(shown(r[i]) for i in at) for r in found.fetchall())
