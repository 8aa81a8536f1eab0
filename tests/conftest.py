import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from leafloom.session import build

    s = build("tests", cores=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compare a query's rows with the rows of its SQL; gives their number."""
    from collections import Counter

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def run(df, sql):
        cols = sorted(df.columns)
        got = Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
        res = duck.execute(sql)
        names = [c[0] for c in res.description]
        assert sorted(names) == cols
        want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
        return sum(got.values())

    return run
