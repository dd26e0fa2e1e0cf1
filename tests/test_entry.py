import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def tidy(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 8) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    large = name == "hard_negative_select"  # no negative passes the filters in fewer rows
    if large:
        db.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.01" if large else DATA)
    found = db.execute(ORACLES[name])
    if large:
        assert df.count() > 0
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = found.fetchall()
    if large:
        db.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert tidy(df.collect(), df.columns) == tidy(rows, names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
