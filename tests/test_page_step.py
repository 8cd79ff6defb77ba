"""Pages are read once, by many tasks, whatever file their rows come from."""

import pytest
from pyspark.sql import functions as F

from orgloom.plans import queries_store
from orgloom.plans.registry import Tables


@pytest.mark.parametrize("name", ["s12_anchored_jobs", "s13_harvest", "s14_member_pages", "c12_openings", "c14_layers", "c15_listings", "s10_board_listing"])
def test_pages_are_read_once(spark, sf_dir, name):
    plan = queries_store.Q.plans[name](Tables(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [parse_page(") == 1


def test_one_row_group_is_dealt(spark, sf_dir):
    for pages in (queries_store.FETCHED, queries_store.DIRECTORY_PAGES):
        tasks = pages(Tables(spark, sf_dir)).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("rows")).collect()
        assert len(tasks) == 4 and max(t["rows"] for t in tasks) < 100  # of 200
