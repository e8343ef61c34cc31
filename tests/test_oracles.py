"""Every registered query against its DuckDB oracle (the driver's gate), on the smallest tables."""
import pytest

from callwright.plans.catalog import ORACLES, QUERIES
from callwright.plans.compare import compare

from .conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(QUERIES[name](spark, SF_SMALL), ORACLES[name], duck_small)
    assert res["ok"], res


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_column_types_match_oracle(spark, duck_small, name):
    df = QUERIES[name](spark, SF_SMALL)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = duck_small.sql(ORACLES[name])
    duck_types = {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
