"""Order-insensitive comparison of query results (the driver's check, locally)."""

import datetime as dt
import decimal
import json
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: json.dumps(r, default=str))


def same_result(spark_df, duck_con, sql):
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    cur = duck_con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols), (sorted(scols), sorted(dcols))
    a, b = canon(scols, srows), canon(dcols, drows)
    assert len(a) == len(b), (len(a), len(b))
    diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
    assert not diffs, diffs
