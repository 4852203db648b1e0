import pytest

from tests.compare import connection, rows
from tests.conftest import DATA
from tessera import registry

registry.load()


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    ours = rows(registry.QUERIES[name](spark, DATA).toPandas())
    theirs = rows(duck.sql(registry.ORACLE[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
