"""Every registered query that has SQL, against that SQL on the smallest tables; the others give rows."""

import pytest
from compare import same

from twinfold.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert same(QUERIES[name](spark, SF), SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"penalised_fit"}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
