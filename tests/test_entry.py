import pytest
from check_oracles import compare, duck

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["req_id", "status", "location"]
    assert frame.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_equals_its_sql(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR).split(" ")[0] in ("ok", "rows-only")
