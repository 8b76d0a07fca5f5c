"""Every registered query with SQL gives that SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from reasonflow.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't there")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tmp_path, name):
    df = QUERIES[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    if name not in ORACLES:
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0
        return
    con.execute(f"CREATE OR REPLACE TABLE a AS {ORACLES[name]}")
    con.execute(f"CREATE OR REPLACE TABLE b AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert sorted(con.execute("DESCRIBE a").fetchall()) == sorted(con.execute("DESCRIBE b").fetchall())
    cols = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE a").fetchall())
    for x, y in ("ab", "ba"):
        assert con.execute(f"SELECT {cols} FROM {x} EXCEPT ALL SELECT {cols} FROM {y} LIMIT 3").fetchall() == []
