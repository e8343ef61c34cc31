"""Order-sensitive queries give the same rows whatever the shuffle partition count."""
import pytest

from callwright.plans.catalog import QUERIES

from .conftest import SF_MID

ORDER_SENSITIVE = [
    "split_exact",
    "pair_functions",
    "pair_singles",
    "template_expand",
    "group_by_query",
    "augment_rules",
    "half_sample",
    "rows_by_function",
    "func_arg_value_list",
    "by_function_document",
    "source_json_array",
]


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_same_result_for_any_partition_count(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.catalog.clearCache()
            results.append(sorted((tuple(r) for r in QUERIES[name](spark, SF_MID).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
