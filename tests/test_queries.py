import duckdb
import pandas as pd
import pytest

from wavetally import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: None if v is None or (isinstance(v, float) and v != v) else round(float(v), 7) if isinstance(v, float) else int(v) if isinstance(v, bool | int) else str(v)
    return sorted((tuple(one(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, FOLDER)
    data = [tuple(r) for r in got.collect()]
    assert got.columns and data
    if name in queries.SQL:
        cur = db.execute(queries.SQL[name])
        want_columns = [c[0] for c in cur.description]
        assert sorted(got.columns) == sorted(want_columns)
        assert rows(got.columns, data) == rows(want_columns, cur.fetchall())


def test_selected_pair(spark):
    got = queries.select_pair(spark, FOLDER).collect()
    assert [(r["first"], r["second"], r["distance"]) for r in got] == [("SSLLSLSL", "SSLSLSLL", 4)]


def test_quantiles_are_exact(spark):
    got = queries.quantile_interval(spark, FOLDER).orderBy("l_returnflag").first()
    x = pd.read_parquet(f"{FOLDER}/lineitem.parquet").query("l_returnflag == 'A'")["l_extendedprice"]
    assert got["low"] == pytest.approx(x.quantile(0.025))
