import pytest

from cairn.plans import archives, catalogue  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, same_as_sql, name):
    same_as_sql(catalogue.QUERIES[name](spark, sf), catalogue.SQL[name])


def test_queries_without_sql_give_rows(spark, sf):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
