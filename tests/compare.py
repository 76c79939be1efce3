"""Rows of a query and of its SQL, as sorted tuples of plain values."""


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(abs(x - y) <= 2e-6 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)
