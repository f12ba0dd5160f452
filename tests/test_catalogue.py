import pytest

from tests.compare import check
from tidewheel.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    check(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)


def test_scans_read_the_columns_they_need(spark):
    plan = catalogue.queries()["result_clicks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "props" not in plan.split("ReadSchema")[1]
