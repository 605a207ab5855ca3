"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries over alignments, whose ties SQL doesn't break alike; their rows are checked against loops.
WITHOUT_SQL = {"wer_line", "error_confusions", "alignment_ops", "errors_by_length", "confusion_distances", "top_missed_words", "error_sample"}
QUERIES, SQL = entry.catalogue.QUERIES, entry.catalogue.ORACLE_SQL


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    con = duckdb.connect()
    con.execute(f"set temp_directory='{tmp_path_factory.mktemp('duck')}'; set max_temp_directory_size='2GB'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name in SQL:
        out = db.execute(SQL[name])
        names = [x[0] for x in out.description]
        assert sorted(names) == cols
        want = sorted(([norm(r[names.index(c)]) for c in cols] for r in out.fetchall()), key=repr)
        assert got == want
    else:
        assert name in WITHOUT_SQL  # checked by loops in test_brute


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_wer_line_has_whole_lines(spark):
    lines = {(r["doc_id"], r["line_no"]) for r in QUERIES["cer_line"](spark, DATA).collect()}
    rows = [tuple(r)[:3] for r in QUERIES["wer_line"](spark, DATA).select("doc_id", "line_no", "metric").collect()]
    assert len(rows) == len(set(rows)) == 8 * len(lines) and {r[:2] for r in rows} == lines
