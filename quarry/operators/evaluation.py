"""Metrics of decisions, calibration and its fit, regression gates.

Records: (line_id, label, item_code, confidence, decision, candidates), and whatever columns they are grouped by. A blank
label means that nothing should be accepted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import beta_mean, nearest_rank, ratio, wilson

#: Seconds gained or lost by a correct and a wrong decision and by an abstention, and against reviewing all.
UTILITY, IMPROVEMENT = (20, -800, -40), (60, -760)
THRESHOLDS = (0.0, 0.93, 0.95, 0.975, 0.99, 1.0)
PROPOSALS = (0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0)
#: What a bucket needs to be enabled.
LEAST_ROWS, LEAST_PRECISION, LEAST_PROBABILITY = 10, 0.98, 760 / 820
NEVER = ("blocked", "no_candidate")
#: The gates of a release: metric, comparison, bound.
GATES = (("lines", "=", 114.0), ("wrong_auto", "=", 0.0), ("precision", ">=", 0.98), ("coverage", ">=", 0.2), ("improvement_over_all_review", ">=", 1200.0), ("recall_at_3", ">=", 0.8), ("ece", "<=", 0.1), ("brier", "<=", 0.16), ("warm_p95_ms", "<=", 250.0), ("stale_files", "=", 0.0))


def _answerable() -> Column:
    return F.col("label") != ""


def _hit() -> Column:
    return _answerable() & F.coalesce(F.array_contains("candidates.item_code", F.col("label")), F.lit(False))


def _top_correct() -> Column:
    return F.coalesce(F.get("candidates", F.lit(0))["item_code"] == F.col("label"), F.lit(False))


def summarise(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of each group, one row of everything if by is empty. Rates of nothing are null."""
    auto, answer = F.col("decision") == "auto", _answerable()
    counts = {
        "lines": F.lit(True),
        "auto": auto,
        "correct_auto": auto & answer & (F.col("item_code") == F.col("label")),
        "wrong_auto": auto & ~(answer & (F.col("item_code") == F.col("label"))),
        "review": F.col("decision") == "review",
        "reject": F.col("decision") == "reject",
        "answerable": answer,
        "unanswerable": ~answer,
        "correct_abstentions": ~auto & ~answer,
        "answerable_abstentions": ~auto & answer,
        "top3_hits": _hit(),
        "abstained_top3_hits": ~auto & _hit(),
    }
    agg = records.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    c = {n: F.col(n) for n in counts}
    a = c["review"] + c["reject"]
    return agg.select(
        *by,
        *counts,
        ratio(c["correct_auto"], c["auto"]).alias("precision"),
        ratio(c["auto"], c["lines"]).alias("coverage"),
        ratio(c["correct_auto"] + c["correct_abstentions"], c["lines"]).alias("accuracy_including_correct_abstention"),
        ratio(c["correct_abstentions"], c["unanswerable"]).alias("blank_label_abstention_rate"),
        ratio(c["top3_hits"], c["answerable"]).alias("recall_at_3"),
        ratio(c["abstained_top3_hits"], c["answerable_abstentions"]).alias("recall_at_3_on_answerable_abstentions"),
        (UTILITY[0] * c["correct_auto"] + UTILITY[1] * c["wrong_auto"] + UTILITY[2] * a).alias("utility_seconds_equivalent"),
        (IMPROVEMENT[0] * c["correct_auto"] + IMPROVEMENT[1] * c["wrong_auto"]).alias("improvement_over_all_review"),
    )


def summaries(records: DataFrame, flags: str = "flags") -> DataFrame:
    """Overall, by tenant and by each noise flag (a line counts under each of its flags): scope, segment, metrics."""
    scopes = F.explode(F.concat(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("segment")), F.struct(F.lit("tenant").alias("scope"), F.col("tenant").alias("segment"))), F.transform(flags, lambda f: F.struct(F.lit("noise_flag").alias("scope"), f.alias("segment")))))
    spread = records.withColumn("s", scopes).withColumns({"scope": F.col("s.scope"), "segment": F.col("s.segment")})
    return summarise(spread, ("scope", "segment"))


def threshold_curve(records: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The summary if automatic decisions below each confidence went to review."""
    each = records.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    back = (F.col("decision") == "auto") & (F.col("confidence") < F.col("threshold"))
    return summarise(each.withColumn("item_code", F.when(back, "").otherwise(F.col("item_code"))).withColumn("decision", F.when(back, "review").otherwise(F.col("decision"))), ("threshold",))


def proposal_curve(retrievals: DataFrame, thresholds: Sequence[float] = PROPOSALS, close: float = 0.05, labels: DataFrame | None = None) -> DataFrame:
    """At each score: how many lines without issues and with a clear margin would be proposed, and how many rightly.

    labels: (line_id, label), where the retrievals have none; a line meets its label with no more than what it would propose.
    """
    first = F.get("candidates", F.lit(0))
    fit = (F.size("candidates") > 0) & (F.size("issues") == 0) & (F.col("margin") >= close)
    some = [F.when(fit, first[c]).alias(c) for c in ("code", "score")]
    lines = retrievals.select("label", *some) if labels is None else retrievals.select("line_id", *some).join(labels.select("line_id", "label"), "line_id")
    each = lines.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    go = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    right = go & F.coalesce(F.col("code") == F.col("label"), F.lit(False))
    return each.groupBy("threshold").agg(F.count_if(go).alias("proposed"), F.count_if(right).alias("correct")).withColumn("precision", ratio(F.col("correct"), F.col("proposed")))


def calibration(records: DataFrame) -> DataFrame:
    """By confidence, to six places: n, correct top candidates, observed share."""
    g = records.groupBy(F.format_string("%.6f", "confidence").alias("bucket_confidence")).agg(F.count("*").alias("n"), F.count_if(_top_correct()).alias("correct"), F.max("confidence").alias("confidence"))
    return g.withColumn("observed", ratio(F.col("correct"), F.col("n")))


def calibration_error(records: DataFrame) -> DataFrame:
    """ece, the mean distance of confidence and observed share, and brier, the mean squared one."""
    ece = calibration(records).agg(ratio(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("observed"))), F.sum("n")).alias("ece"))
    brier = records.agg(F.avg(F.pow(F.col("confidence") - _top_correct().cast("int"), F.lit(2.0))).alias("brier"))
    return ece.join(brier)  # one row each


def fit_buckets(records: DataFrame) -> DataFrame:
    """By bucket of evidence: n, correct, probability, observed precision, its Wilson interval, enabled.

    records: (bucket, correct) of development lines. Buckets without candidates have probability 0 and are never enabled.
    """
    g = records.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))
    n, c = F.col("n"), F.col("correct")
    low, high = wilson(c, n)
    p = F.when(F.col("bucket") == "no_candidate", 0.0).otherwise(beta_mean(c, n))
    g = g.select("bucket", "n", "correct", p.alias("probability"), ratio(c, n).alias("observed_precision"), low.alias("wilson_low"), high.alias("wilson_high"))
    on = ~F.col("bucket").isin(*NEVER) & (n >= LEAST_ROWS) & (F.col("observed_precision") >= LEAST_PRECISION) & (F.col("probability") > LEAST_PROBABILITY)
    return g.withColumn("enabled", on)


def release_metrics(records: DataFrame, seconds_ms: DataFrame, then: DataFrame, now: DataFrame) -> DataFrame:
    """The row that gates() takes: summary, calibration errors, p95 of warm times, and files that are not what was evaluated.

    seconds_ms: (ms), a row for each timed call; then, now: (path, sha256) at the evaluation and at the release.
    """
    stale = then.join(now.select("path", F.col("sha256").alias("found")), "path", "full").agg(F.count_if(~F.col("sha256").eqNullSafe(F.col("found"))).alias("stale_files"))
    p95 = seconds_ms.agg(nearest_rank("ms").alias("warm_p95_ms"))
    return summarise(records).join(calibration_error(records)).join(p95).join(stale)  # one row each


def gates(metrics: DataFrame, rules: Sequence[tuple[str, str, float]] = GATES) -> DataFrame:
    """(gate, value, bound, passed) of one row of metrics; a missing value fails."""
    have = set(metrics.columns)
    row = lambda n, op, b: F.struct(F.lit(f"{n} {op}").alias("gate"), (F.col(n).cast("double") if n in have else F.lit(None).cast("double")).alias("value"), F.lit(float(b)).alias("bound"))
    rows = metrics.select(F.explode(F.array(*(row(*r) for r in rules))).alias("g")).select("g.gate", "g.value", "g.bound")
    ok = F.when(F.col("gate").endswith(">="), F.col("value") >= F.col("bound")).when(F.col("gate").endswith("<="), F.col("value") <= F.col("bound")).otherwise(F.col("value") == F.col("bound"))
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))


def identifier_counters(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """(counter, n): lines with identifier candidates, with the target among them, with one and no issue, and by issue."""
    j = evidence.join(labels, "line_id")
    hit = (F.col("label") != "") & F.array_contains("codes", F.col("label"))
    names = F.concat(
        F.array_compact(F.array(F.lit("lines"), F.when(F.size("codes") > 0, "with_candidates"), F.when(hit, "target_retrieved"), F.when((F.size("codes") == 1) & (F.size("issues") == 0), "unique_without_issue"))),
        F.transform("issues", lambda i: F.concat(F.lit("issue:"), i)),
    )
    return j.select(F.explode(names).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def audit_catalogue(catalogue: DataFrame) -> DataFrame:
    """By tenant: rows, disabled rows, names that several visible rows share."""
    shared = catalogue.where("disabled = '0'").groupBy("tenant", F.upper(F.trim("item_name")).alias("name")).count().where("count > 1").groupBy("tenant").agg(F.count("*").alias("duplicate_name_groups"))
    return catalogue.groupBy("tenant").agg(F.count("*").alias("rows"), F.count_if(F.col("disabled") == "1").alias("disabled")).join(shared, "tenant", "left").na.fill(0, ["duplicate_name_groups"])


def audit_aliases(aliases: DataFrame) -> DataFrame:
    """One row: rows, keys with several targets, inferred rows, rows of confidence below 1, rows with an end date."""
    keys = aliases.groupBy("tenant", "customer_id", "customer_sku").agg(F.count_distinct("item_code").alias("targets"), F.count("*").alias("n"), F.count_if(F.col("source") == "inferred_match").alias("inferred"), F.count_if(F.expr("try_cast(confidence as double) < 1")).alias("weak"), F.count_if(F.col("valid_to") != "").alias("ended"))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return keys.agg(total("n", "rows"), F.count_if(F.col("targets") > 1).alias("ambiguous_keys"), total("inferred", "inferred"), total("weak", "below_full_confidence"), total("ended", "with_end_date"))


def review_queue(retrievals: DataFrame, n: int = 20, position: str = "position") -> DataFrame:
    """The first n lines, in input order, whose best candidate is not the label."""
    return retrievals.where((F.col("label") != "") & ~F.coalesce(F.get("candidates", F.lit(0))["code"] == F.col("label"), F.lit(False))).orderBy(position).limit(n)
