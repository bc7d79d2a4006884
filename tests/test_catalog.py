import pytest

from __spark_entry__ import entry, oracle_sql
from comity.plans.catalog import QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "toxic_comments" in df.columns


#: Plans that start from a table which the query itself has written: the work before it has
#: run by then, so looking at them again would only repeat training and draining.
WRITTEN_FIRST = (
    "train_classifier", "training_epochs", "stream_history", "stream_daily", "stream_scores",
    "stream_then_erase", "upload_then_recent", "indexed_search", "kept_dashboard",
    "stream_daily_folded", "history_table_page",
)


def test_only_training_has_no_sql():
    assert set(QUERIES) - set(oracle_sql()) == {"train_classifier"}


def test_no_plan_holds_a_cross_join(spark):
    for name, run in QUERIES.items():
        if name in WRITTEN_FIRST:
            continue
        plan = run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
