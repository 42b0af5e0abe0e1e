"""What the tests share."""

DATA = "/root/testdata/sf0.001"


def rows(df, *order):
    """A DataFrame's rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(frame):
    """A pandas frame with comparable values, in a fixed order."""
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        numeric = out[c].dtype.kind in "if" or str(out[c].dtype) in ("Int32", "Int64", "Float64")
        out[c] = out[c].astype(float).round(6) if numeric else out[c].astype(str).replace({"<NA>": "None", "nan": "None", "NaN": "None"})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(spark, duck, query, sql):
    a, b = plain(query(spark, DATA).toPandas()), plain(duck.sql(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        assert not bad.any(), f"{c}: {a[bad].head(2)} {b[bad].head(2)}"
