"""Every registered query of the engine runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

from tidewatch.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in ("events", "orders"):
        path = f"{data}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, data, tmp_path, name):
    df = QUERIES[name](spark, data)
    df.write.parquet(str(tmp_path / "out"))
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    duck.sql(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {cols} FROM ({SQL[name]})")
    got = f"SELECT {cols} FROM read_parquet('{tmp_path}/out/*.parquet')"
    assert duck.sql(f"SELECT {cols} FROM want EXCEPT ALL {got}").fetchall() == []
    assert duck.sql(f"{got} EXCEPT ALL SELECT {cols} FROM want").fetchall() == []
