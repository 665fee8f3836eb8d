"""Every query with SQL against DuckDB on the same tables."""

import math

import pytest

from voxelbrick.plans import registry

SQL = registry.oracle_sql()


def _key(row):
    out = []
    for v in row:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            out.append((0, ""))
        elif isinstance(v, bool):
            out.append((1, str(v)))
        elif isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
            out.append((2, f"{round(float(v), 5) + 0.0:.5f}"))
        else:
            out.append((3, str(v)))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_answer(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf)
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(map(_key, cur.fetchall()))
    have = sorted(_key([r[c] for c in columns]) for r in got.collect())
    assert len(have) == len(want)
    assert have == want


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 2
