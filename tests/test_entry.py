from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


def test_entry(spark):
    assert E.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in E.queries()))
def test_query_is_its_sql(spark, db, name):
    frame, sql = E.queries()[name](spark, SF), db.sql(E.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert sorted(sql.columns) == columns
    assert norm(map(tuple, frame.select(columns).collect())) == norm(sql.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in E.oracle_sql() and n != "pipeline"))
def test_other_queries_give_rows(spark, name):
    rows = E.queries()[name](spark, SF).count()
    assert rows > 0 or name == "reordered"  # the smallest table has none
