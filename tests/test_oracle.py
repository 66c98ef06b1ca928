import os

import pytest
from oracle import SF, compare

from brookmill.plans import queries as plans

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, plans.queries()[name], plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() >= 0


def test_no_python_in_relational_queries(spark):
    for name in ("cls_report", "forecast_metrics_row", "seq_length", "pack_batches", "conversation_build", "p3_found"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        if name != "p3_found":
            assert "Python" not in plan and "Pandas" not in plan, name
