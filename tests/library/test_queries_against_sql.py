"""Every registered query runs on the smallest tables; where SQL is given, the rows must be the same."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pytest

from auralake import queries as own

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = own.queries(), own.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating | decimal.Decimal):
        return "%.6g" % v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        return
    expected = db.execute(SQL[name]).fetchall()
    columns = [c[0] for c in db.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in expected)
    assert ours == theirs


def test_fingerprint_values_rounded_to_zero_have_no_sign(spark, tmp_path):
    """Each text of one block has a value within 0.00005 dB of the mean, on either side; a zero is the same to the last bit."""
    texts = ["".join(chr(97 + (a * i**3 + b * i**2) % 997 % 26) for i in range(500)) for a, b in ((30, 367), (26, 272), (41, 606), (41, 685))]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    theirs = sorted(con.execute(SQL["u4_fingerprints"]).fetchall())
    ours = sorted((r["clip_id"], r["frames"], list(r["fingerprint"])) for r in QUERIES["u4_fingerprints"](spark, str(tmp_path)).collect())
    assert [len([v for v in r[2] if v == 0]) for r in theirs] == [1, 1, 1, 1]
    assert str(ours) == str(theirs)
