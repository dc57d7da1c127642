"""Every query with a SQL twin gives the rows that DuckDB gives; the others give rows."""

import pytest

from driftloom import queries


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    assert rows(queries.queries()[name](spark, sf_dir).toPandas()) == rows(duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
