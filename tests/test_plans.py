"""Shuffles and scans of plans that should stay small."""

from lacuna.operators import classes as C
from lacuna.plans import end_to_end as E
from lacuna.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_certain_aggregate_is_one_shuffle_and_one_scan(spark):
    plan = _plan(E.aggregate(fx.f2(spark, SF), "obj", fx.F2_ATTRS, "certain", members=False))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_one_half_of_the_classes_needs_no_shuffle(spark):
    plan = _plan(C.classes(fx.f2(spark, SF), "obj", fx.F2_ATTRS, kind="certain"))
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_selected_attributes_read_their_columns_alone(spark):
    plan = _plan(C.unpivot(fx.f2(spark, SF), "obj", [*fx.F2_ATTRS, "d"], only=[1]))
    schema = plan[plan.index("ReadSchema") :]
    assert "p_brand" in schema and "p_type" not in schema and "p_size" not in schema


def test_possible_class_digests_have_no_object_fan_out(spark):
    cells = C.unpivot(fx.f2(spark, SF), "obj", fx.F2_ATTRS)
    plan = _plan(C.possible_class_stats(cells))
    assert plan.index("Join") < plan.index("HashAggregate")  # the join stands above the aggregates, on their few rows
