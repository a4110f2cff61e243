"""Plan properties that keep the queries scalable."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = E.queries()
TOP_N = ["bm25_search", "like_fallback", "vector_topk", "series_range", "sweep_chunk", "hybrid_search",
         "top_formats"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan_of(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("name", TOP_N)
def test_top_n_limits_each_partition_first(spark, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, SF_SMALL))
