"""weighted_category sorts its lines once."""

from ledgerloom.plans import registry


def test_lines_are_read_and_sorted_once(spark):
    plan = registry.queries()["weighted_category"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan
