"""Every registered query against its oracle at the smallest scale."""

import datetime as dt
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    if isinstance(a, dt.datetime):
        return a.replace(tzinfo=None) == b.replace(tzinfo=None)
    return a == b


def _key(row):
    return tuple((v is None, str(round(v, 3)) if isinstance(v, float) else str(v)) for v in row)


def test_every_query_has_an_oracle():
    """Only queries of the optional subpackage may do without; they are held against plain versions in their own tests."""
    assert set(ORACLES) <= set(QUERIES)
    assert all(re.match(r"(op\d+_|pipeline$|benchmark_proximity$)", name) for name in set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    cur = con.execute(ORACLES[name])
    heads = [c[0] for c in cur.description]
    assert sorted(heads) == names
    want = sorted((tuple(r[heads.index(n)] for n in names) for r in cur.fetchall()), key=_key)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if not all(_same(a, b) for a, b in zip(g, w))]
    assert not wrong, wrong[:3]
