"""Match-health report: a row for each tenant, channel and day, its columns built from a registry of metrics.

Inputs: tenants (tenant_id, plan), order_lines (line_id, tenant_id, customer_id, channel, day), events (line_id,
tenant_id, item_code, accepted, score, latency_ms, day), items (tenant_id, item_code, disabled). Metrics differ in whose
tenant and day they count by:
- lines_accepted: the event's tenant with the order's channel and day;
- candidates_considered: the order's tenant, channel and day;
- scores, latencies, disabled and repeated items: the event's tenant and day, on every channel's row.
Counts default to 0, averages, maxima and percentiles to null. Only rows are limited to the window, not what they count:
repeated items look one day back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import previous_day
from ..functions.stats import nearest_rank, steady_avg

LINE_KEYS, EVENT_KEYS = ("tenant_id", "channel", "day"), ("tenant_id", "day")


@dataclass(frozen=True)
class Metric:
    """population: which rows it counts; keys: of its groups; value: its aggregate; default: where a group has no rows."""

    name: str
    population: str
    value: Callable[[], F.Column]
    default: object = None


accepted = lambda c: F.when(F.col("accepted") == 1, c)

METRICS = (
    Metric("lines_accepted", "accepted_lines", lambda: F.count_distinct("line_id"), 0),
    Metric("candidates_considered", "order_events", lambda: F.sum("n"), 0),
    Metric("avg_accept_score", "events", lambda: steady_avg(accepted(F.col("score")))),
    Metric("max_latency_ms", "events", lambda: F.max("latency_ms")),
    Metric("avg_latency_ms", "events", lambda: F.avg("latency_ms")),
    Metric("distinct_customers", "orders", lambda: F.count_distinct("customer_id"), 0),
    Metric("repeat_items_prev_day", "repeats", lambda: F.count("*"), 0),
    Metric("accepted_disabled", "disabled", lambda: F.count("*"), 0),
    Metric("p95_latency_ms", "events", lambda: nearest_rank("latency_ms")),
)
COLUMNS = ("tenant_id", "plan", "channel", "day", "lines_total", *(m.name for m in METRICS))


def prior_month(c):
    """The text of the month before a text month."""
    return F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), -1), "yyyy-MM")


def match_health(tenants: DataFrame, order_lines: DataFrame, events: DataFrame, items: DataFrame, first: str, last: str, names: Sequence[str] | None = None, only_tenants: Sequence[str] | None = None, prior: Callable = previous_day) -> DataFrame:
    """The report from day `first` to `last`. names: metrics to compute, all by default, so that a column can be left out
    to see what it costs; only_tenants: rows of these tenants only; prior: the grain's step back."""
    wanted = [m for m in METRICS if names is None or m.name in names]
    used = {m.population for m in wanted}
    rows = order_lines.where(F.col("day").between(first, last))
    if only_tenants is not None:
        rows = rows.where(F.col("tenant_id").isin(list(only_tenants)))
    groups = rows.join(tenants.select("tenant_id", "plan"), "tenant_id").groupBy("tenant_id", "plan", "channel", "day").agg(F.count_distinct("line_id").alias("lines_total"))
    population: dict[str, tuple[DataFrame, tuple[str, ...]]] = {"orders": (order_lines, LINE_KEYS), "events": (events, EVENT_KEYS)}
    if used & {"accepted_lines", "order_events"}:
        # Events meet their orders once for each line and tenant, not one by one.
        per_line = events.groupBy("line_id", "tenant_id").agg(F.count("*").alias("n"), F.max("accepted").alias("accepted"))
        lines = order_lines.where(F.col("day").between(first, last)).select("line_id", F.col("tenant_id").alias("order_tenant"), "channel", "day")
        both = per_line.join(lines, "line_id")
        population["accepted_lines"] = (both.where("accepted = 1").select("line_id", "tenant_id", "channel", "day"), LINE_KEYS)
        population["order_events"] = (both.select(F.col("order_tenant").alias("tenant_id"), "channel", "day", "n"), LINE_KEYS)
    if "repeats" in used:
        seen = events.where("accepted = 1").select("tenant_id", "day", "item_code").distinct()
        before = seen.select("tenant_id", F.col("day").alias("before"), "item_code")
        population["repeats"] = (seen.withColumn("before", prior(F.col("day"))).join(before, ["tenant_id", "before", "item_code"], "left_semi"), EVENT_KEYS)
    if "disabled" in used:
        off = items.where("disabled = 1").select("tenant_id", "item_code").distinct()
        population["disabled"] = (events.where("accepted = 1").join(off, ["tenant_id", "item_code"], "left_semi"), EVENT_KEYS)
    out = groups
    # All that is keyed as the groups are comes first: one dealing of the groups serves those joins, another the rest.
    for kind in sorted(used, key=lambda p: (population[p][1] != LINE_KEYS, p)):
        df, keys = population[kind]
        own = [m for m in wanted if m.population == kind]
        if keys == LINE_KEYS or kind == "events":
            df = df.where(F.col("day").between(first, last))
        out = out.join(df.groupBy(*keys).agg(*(m.value().alias(m.name) for m in own)), list(keys), "left")
    value = lambda m: F.col(m.name) if m.default is None else F.coalesce(m.name, F.lit(m.default)).alias(m.name)
    return out.select("tenant_id", "plan", "channel", "day", "lines_total", *(value(m) for m in wanted)).orderBy("tenant_id", "channel", "day")


def p95_by_window(events: DataFrame, value: str = "latency_ms") -> DataFrame:
    """The 95th nearest-rank percentile by rank and count over windows: a second way to the same figure."""
    from pyspark.sql import Window

    known = events.where(F.col(value).isNotNull())
    w = Window.partitionBy("tenant_id", "day")
    ranked = known.select("tenant_id", "day", value, F.row_number().over(w.orderBy(value)).alias("rn"), F.count("*").over(w).alias("n"))
    return ranked.where(F.expr("rn = (95 * n + 99) div 100")).select("tenant_id", "day", F.col(value).alias("p95_latency_ms"))


def normalised(df: DataFrame, places: int = 6) -> DataFrame:
    """With floating columns rounded: what two reports are compared by."""
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def differences(a: DataFrame, b: DataFrame, places: int = 6) -> DataFrame:
    """Rows of either report that the other lacks, as often as they occur."""
    a, b = normalised(a, places), normalised(b, places)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
