"""Every registered query against its SQL on the smallest data set."""

import pytest

from basketry.plans import QUERIES
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(spark, engine, name):
    frame = QUERIES[name].run(spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    answer = engine.execute(QUERIES[name].sql)
    columns = [d[0] for d in answer.description]
    assert compare(frame.columns, rows, columns, answer.fetchall()) is None
    assert rows


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
