"""The text operators' queries give the rows of their SQL."""

import math

import duckdb
import pytest

from glyphspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    con = duckdb.connect()
    con.execute(f"set temp_directory='{tmp_path_factory.mktemp('duck')}'; set max_temp_directory_size='2GB'")
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    norm = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
    out = db.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = sorted(([norm(r[names.index(c)]) for c in cols] for r in out.fetchall()), key=repr)
    assert got and got == want
