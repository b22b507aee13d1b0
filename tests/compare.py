import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v) + 0.0:.4f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, duck, sql):
    got, want = df.collect(), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
