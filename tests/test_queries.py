"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    message, _ = compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert not message


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["label_id", "entries", "thin"]
    assert df.count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
