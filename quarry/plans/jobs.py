"""Whole jobs: prediction, evaluation, fitting, audit, report checks."""

from __future__ import annotations

import statistics
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import decision, evaluation, identifiers, lexical, report, split
from ..sources import files
from .scratch import Scratch


def predict(spark: SparkSession, folder: str, lines_path: str, policy_path: str, out: str, cold_start: bool = False) -> DataFrame:
    """Matches every line of a file, checks the contract and that a second run agrees, writes predictions and a manifest."""
    s = Scratch(spark, "predict")
    catalogue = files.read_catalogue(spark, folder)
    aliases = files.read_aliases(spark, f"{folder}/customer_sku_map.csv", cold_start)
    lines, _ = files.read_order_lines(spark, lines_path)
    policy = files.read_policy(spark, policy_path)
    once = lambda: s.table(decision.match(s, lines, catalogue, policy, aliases), "results")
    results = once()
    if broken := decision.violations(results, lines, catalogue).take(1):
        raise ValueError(f"{broken[0]['line_id']} breaks the contract: {', '.join(broken[0]['broken'])}")
    if not decision.same_rows(results, once()).isEmpty():
        raise ValueError("two runs differ")
    files.write_predictions(results.orderBy("line_id"), f"{out}/predictions")
    consumed = [f"{folder}/catalogue_*.csv", lines_path, policy_path, *([] if cold_start else [f"{folder}/customer_sku_map.csv"])]
    files.write_json(files.manifest(spark, *consumed), f"{out}/manifest")
    return results


def evaluated(spark: SparkSession, folder: str, train_path: str, cold_start: bool = False, split_path: str = "") -> tuple[DataFrame, DataFrame]:
    """(retrievals with bucket, label and partition; the lines) of a labelled file. split_path: a split written before, which
    must have exactly the file's lines; else one is made."""
    s = Scratch(spark, "evaluate")
    catalogue = files.read_catalogue(spark, folder)
    aliases = files.read_aliases(spark, f"{folder}/customer_sku_map.csv", cold_start)
    lines, labels = files.read_order_lines(spark, train_path, labelled=True)
    lines, labelled = s.table(lines, "lines"), s.table(lines.join(labels, "line_id"), "labelled")
    evidence = identifiers.retrieve_identifiers(s, lines, catalogue, aliases)
    retrieval = s.table(lexical.retrieve(s, lines, catalogue, evidence), "retrieval")
    parts = files.read_split(spark, split_path) if split_path else split.build_split(s, labelled)
    if split_path and not parts.select("line_id").exceptAll(labelled.select("line_id")).unionByName(labelled.select("line_id").exceptAll(parts.select("line_id"))).isEmpty():
        raise ValueError("the split is of other lines")
    rows = retrieval.drop("tenant").where("codes is not null").withColumn("bucket", decision.bucket())
    return s.table(rows.join(labelled.select("line_id", "label"), "line_id").join(parts, "line_id"), "evaluated"), labelled


def fit(rows: DataFrame) -> DataFrame:
    """The policy of the development partition of evaluated()."""
    right = F.coalesce(F.get("candidates", F.lit(0))["code"] == F.col("label"), F.lit(False))
    return evaluation.fit_buckets(rows.where("partition = 'development'").select("bucket", right.alias("correct")))


def decided(rows: DataFrame, lines: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows of evaluated() under a policy, as evaluation takes them."""
    made = decision.decide(rows.drop("codes", "bucket"), rows.select("line_id", "codes"), policy)
    flags = X.noise_flags(F.col("raw_text"), F.col("uom_text"), F.col("buyer_sku"), F.col("raw_barcode"))
    return made.join(lines.select("line_id", "tenant", "label", flags.alias("flags")), "line_id")


def measured(rows: DataFrame, lines: DataFrame, policy: DataFrame, partition: str | None = None) -> dict[str, DataFrame]:
    """Summaries, threshold curve, calibration and wrong decisions of a partition under a policy."""
    records = decided(rows if partition is None else rows.where(F.col("partition") == partition), lines, policy)
    return {
        "summary": evaluation.summaries(records),
        "curve": evaluation.threshold_curve(records),
        "calibration": evaluation.calibration(records),
        "error": evaluation.calibration_error(records),
        "wrong": records.where("decision = 'auto' and item_code <> label").select("line_id", "label", "item_code", "reason_code"),
    }


def released(spark: SparkSession, folder: str, train_path: str, policy_path: str, manifest_path: str, split_path: str = "", repeat: int = 5) -> DataFrame:
    """The gates over the validation lines: their summary and calibration, p95 of warm milliseconds a line over `repeat` runs,
    and the files whose hashes are not those of the manifest (as write_json(manifest()) has left it)."""
    rows, lines = evaluated(spark, folder, train_path, split_path=split_path)
    policy = files.read_policy(spark, policy_path)
    n = lines.count()
    again = lambda: evaluated(spark, folder, train_path, split_path=split_path)[0]
    times = [seconds * 1000 / max(1, n) for seconds in (_seconds(again) for _ in range(repeat))]
    then = spark.read.schema("path string, length long, sha256 string").json(manifest_path).select("path", "sha256")
    now = files.manifest(spark, *[r["path"] for r in then.collect()]).select("path", "sha256")  # a handful of files
    records = decided(rows.where("partition = 'validation'"), lines, policy)
    return evaluation.gates(evaluation.release_metrics(records, spark.createDataFrame([(float(t),) for t in times], "ms double"), then, now))


def _seconds(run: Callable[[], object]) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def timed(spark: SparkSession, df: DataFrame, limit: float = 30.0) -> float | None:
    """Seconds to run a plan to its end, None if it was stopped at the limit."""
    group, stopped = uuid.uuid4().hex, threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        stopped.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit, stop)
    sc.setJobGroup(group, "timed", interruptOnCancel=True)
    timer.start()
    began = time.perf_counter()
    try:
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began
    except Exception:
        if stopped.is_set():
            return None
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as Spark explains it."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def ablation(spark: SparkSession, make: Callable[[Sequence[str]], DataFrame], limit: float = 30.0) -> dict[str, float | None]:
    """Seconds of the report with all metrics and without each: make(names) gives the plan."""
    names = [m.name for m in report.METRICS]
    return slices(spark, lambda left_out: make([n for n in names if n != left_out]), {"all": None, **{n: n for n in names}}, limit)


def slices(spark: SparkSession, make: Callable[..., DataFrame], cases: dict[str, object], limit: float = 30.0) -> dict[str, float | None]:
    """Seconds of make(case) for each case, such as more tenants or days at a time; None where the limit stopped it."""
    return {name: timed(spark, make(case), limit) for name, case in cases.items()}


def by_channel(spark: SparkSession, tables: Sequence[DataFrame], first: str, last: str, limit: float = 30.0) -> dict[int, float | None]:
    """Seconds of the report over the lines of the first channel, the first two, and so on."""
    tenants, lines, events, items = tables
    names = sorted(r[0] for r in lines.select("channel").distinct().collect())
    return {n: timed(spark, report.match_health(tenants, lines.where(F.col("channel").isin(names[:n])), events, items, first, last), limit) for n in range(1, len(names) + 1)}


def out_of_order(golden: DataFrame) -> int:
    """Rows of a stored report, numbered by `position`, that do not follow the one before in tenant, channel and day."""
    w = Window.partitionBy("tenant_id").orderBy("position")
    within = golden.select(F.coalesce(F.struct("channel", "day") <= F.lag(F.struct("channel", "day")).over(w), F.lit(False)).alias("wrong"))
    # One row for each tenant.
    ranges = golden.groupBy("tenant_id").agg(F.min("position").alias("low"), F.max("position").alias("high"))
    across = ranges.select(F.coalesce(F.col("low") <= F.lag("high").over(Window.orderBy("tenant_id")), F.lit(False)).alias("wrong"))
    return within.unionByName(across).where("wrong").count()


def baseline(made: DataFrame, path: str) -> None:
    """Stores a report in its order, as check() takes it."""
    made.withColumn("position", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)


def check(spark: SparkSession, make: Callable[[], DataFrame], golden: DataFrame, budget: float = 10.0, repeat: int = 5, strict: bool = False) -> dict:
    """Whether a report equals a golden one, its median seconds against a budget, and the verdict on both.

    strict: every digit counts, and the order of a golden report that has it (position); else values to six places.
    """
    rows = golden.drop("position")
    made = make().select(*rows.columns)
    differ = (decision.same_rows(made, rows) if strict else report.differences(made, rows)).count()
    wrong = out_of_order(golden) if strict and "position" in golden.columns else 0
    times = [timed(spark, make(), 10 * budget) for _ in range(repeat)]
    median = statistics.median(times) if None not in times else None
    within = median is not None and median <= budget
    return {"equal": differ == 0 and wrong == 0, "differing_rows": differ, "rows_out_of_order": wrong, "median_s": median, "within_budget": within, "passed": differ == 0 and wrong == 0 and within}
