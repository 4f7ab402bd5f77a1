"""The join of the radius windows goes by shuffle however small its input looks."""

from sectorflow.operators import joins


def test_no_side_is_broadcast(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts, 30.0D + id * 0.001D AS lat, -97.9D AS lon FROM range(50)")
    plan = joins.radius_window(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "strategy=merge" in plan
    physical = joins.radius_window(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_gx" in physical
