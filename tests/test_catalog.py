"""Every registered query runs on the smallest tables and equals its DuckDB SQL."""

import duckdb
import pandas as pd
import pytest

from statloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "customer supplier part orders lineitem events embeddings labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def table(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v != v:
            return (0, "")
        if isinstance(v, (bool, int, float)) or hasattr(v, "dtype"):
            return (1, round(float(v), 9) + 0.0)
        return (2, str(v))

    return sorted(tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = con.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        for g, w in zip(table(got, columns), table(want, columns), strict=True):
            for (kg, a), (kw, b) in zip(g, w):
                assert kg == kw and (a == b if kg != 1 else a == pytest.approx(b, abs=2e-3, rel=1e-6)), (name, g, w)
    else:
        assert len(got) > 0
