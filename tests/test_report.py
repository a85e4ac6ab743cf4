"""The report's populations, defaults and percentiles on a small ledger, and its plan."""

from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.operators import report
from quarry.sources.ledger import ledger


def small(spark):
    tenants = spark.createDataFrame([("T", "plan")], "tenant_id string, plan string")
    lines = spark.createDataFrame([("L1", "T", "C1", "email", "2026-05-01"), ("L2", "T", "C2", "voice", "2026-05-01"), ("L3", "T", "C3", "email", "2026-05-02")], "line_id string, tenant_id string, customer_id string, channel string, day string")
    ev = [("L1" if i % 2 else "L2", "T", "A", 1, 0.5, i, "2026-05-01") for i in range(1, 21)] + [("L3", "T", "A", 1, 0.7, 200, "2026-05-03"), ("L1", "T", "A", 0, 0.2, 1, "2026-04-30"), ("L1", "T", "A", 1, 0.2, 1, "2026-04-30")][:2]
    events = spark.createDataFrame(ev + [("L9", "T", "A", 1, 0.9, None, "2026-04-30")], "line_id string, tenant_id string, item_code string, accepted int, score double, latency_ms long, day string")
    items = spark.createDataFrame([("T", "A", 1)], "tenant_id string, item_code string, disabled int")
    return tenants, lines, events, items


def test_small_ledger(spark):
    got = [tuple(r) for r in report.match_health(*small(spark), "2026-05-01", "2026-05-02").collect()]
    assert got == [
        ("T", "plan", "email", "2026-05-01", 1, 1, 11, 0.5, 20, 10.5, 1, 1, 20, 19.0),
        ("T", "plan", "email", "2026-05-02", 1, 1, 1, None, None, None, 1, 0, 0, None),
        ("T", "plan", "voice", "2026-05-01", 1, 1, 10, 0.5, 20, 10.5, 1, 1, 20, 19.0),
    ]


def test_slices_and_metrics(spark):
    df = report.match_health(*small(spark), "2026-05-01", "2026-05-02", names=("distinct_customers",), only_tenants=("T",))
    assert df.columns == ["tenant_id", "plan", "channel", "day", "lines_total", "distinct_customers"] and df.count() == 3
    assert report.match_health(*small(spark), "2026-05-01", "2026-05-02", only_tenants=()).count() == 0


def test_percentile_two_ways(spark):
    for n in (1, 7, 20, 40, 41, 100, 180):
        ev = spark.range(1, n + 1).select(F.lit("T").alias("tenant_id"), F.lit("d").alias("day"), F.col("id").alias("latency_ms"))
        want = -(-95 * n // 100)
        assert report.p95_by_window(ev).first()["p95_latency_ms"] == want
        assert ev.groupBy("day").agg(report.nearest_rank("latency_ms").alias("p")).first()["p"] == want


def test_previous_day_beyond_month_end(spark):
    days = {"2026-04-31": "2026-04-30", "2026-05-01": "2026-04-30", "2026-06-31": "2026-06-30", "2026-07-01": "2026-06-30", "2026-02-30": "2026-03-01", "2026-02-31": "2026-03-02", "2026-01-01": "2025-12-31"}
    got = spark.createDataFrame([(d,) for d in days], "d string").select("d", dates.previous_day(F.col("d"))).collect()
    assert {r[0]: r[1] for r in got} == days


def test_ledger_is_the_same_however_it_is_cut(spark):
    a, b = ledger(spark, lines=300)["events"], ledger(spark, lines=300)["events"].repartition(3)
    assert report.differences(a, b).isEmpty()
    n = a.groupBy("line_id").count().agg(F.min("count"), F.max("count")).first()
    assert 3 <= n[0] and n[1] <= 20


def test_plan_has_no_cross_join_and_prunes_columns(spark):
    sf = "/root/testdata/sf0.001"
    from quarry.plans.queries import QUERIES

    plan = QUERIES["report_days"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
