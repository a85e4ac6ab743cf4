"""Summaries, curves, calibration, fit, gates, audits and the split."""

import pytest

from quarry.operators import evaluation as E
from quarry.operators import split

SCHEMA = "line_id string, tenant string, label string, item_code string, confidence double, decision string, candidates array<struct<item_code:string,score:double>>, flags array<string>"


def records(spark, *rows):
    return spark.createDataFrame([(f"L{i}", "t", *r, ["other"]) for i, r in enumerate(rows)], SCHEMA)


def test_all_review(spark):
    got = E.summarise(records(spark, ("A", "", 0.0, "review", []), ("", "", 0.0, "review", []))).first()
    assert (got["precision"], got["coverage"], got["accuracy_including_correct_abstention"], got["utility_seconds_equivalent"], got["recall_at_3"]) == (None, 0.0, 0.5, -80, 0.0)


def test_mixed(spark):
    c = lambda *codes: [(x, 0.5) for x in codes]
    df = records(spark, ("A", "A", 0.9, "auto", c("A")), ("", "B", 0.9, "auto", c("B")), ("C", "", 0.5, "review", c("X", "C")), ("", "", 0.0, "reject", []))
    got = E.summarise(df).first()
    assert (got["precision"], got["coverage"], got["utility_seconds_equivalent"], got["improvement_over_all_review"], got["recall_at_3"], got["blank_label_abstention_rate"]) == (0.5, 0.5, -860, -700, 1.0, 0.5)
    curve = {r["threshold"]: r["auto"] for r in E.threshold_curve(df).collect()}
    assert curve[0.0] == 2 and curve[0.93] == 0
    assert {(r["scope"], r["segment"]): r["lines"] for r in E.summaries(df).collect()} == {("overall", "all"): 4, ("tenant", "t"): 4, ("noise_flag", "other"): 4}
    e = E.calibration_error(df).first()
    assert e["ece"] == pytest.approx((2 * abs(0.9 - 0.5) + abs(0.5) + 0) / 4) and e["brier"] == pytest.approx((0.01 + 0.81 + 0.25 + 0) / 4)
    passed = {r["gate"]: r["passed"] for r in E.gates(E.summarise(df)).collect()}
    assert passed["coverage >="] and not passed["wrong_auto ="] and not passed["ece <="]


def test_empty(spark):
    got = E.summarise(records(spark)).first()
    assert got["lines"] == 0 and got["precision"] is None and got["utility_seconds_equivalent"] == 0


def test_fit(spark):
    counts = {"identifier": (15, 15), "lexical_high": (33, 33), "lexical_other": (56, 56), "lexical_exact": (70, 55), "blocked": (95, 41), "no_candidate": (37, 0)}
    df = spark.createDataFrame([(b, i < c) for b, (n, c) in counts.items() for i in range(n)], "bucket string, correct boolean")
    got = {r["bucket"]: r for r in E.fit_buckets(df).collect()}
    assert got["lexical_exact"]["probability"] == pytest.approx(0.77778, abs=1e-5)
    assert (got["lexical_exact"]["wilson_low"], got["lexical_exact"]["wilson_high"]) == (pytest.approx(0.67609, abs=1e-5), pytest.approx(0.86561, abs=1e-5))
    assert got["no_candidate"]["probability"] == 0.0
    assert {b for b, r in got.items() if r["enabled"]} == {"identifier", "lexical_high", "lexical_other"}


def test_split(spark, scratch):
    rows = [("L1", "t", "a", "", "c", "S", ""), ("L2", "t", "b", "X", "c", "S", ""), ("L3", "t", "d", "X", "c", "", ""), ("L4", "t", "Ä  a!", "", "c", "", "9"), ("L5", "u", "a", "X", "c", "S", "9"), ("L6", "t", "ä A", "", "c", "", "")]
    schema = "line_id string, tenant string, raw_text string, label string, customer_id string, buyer_sku string, raw_barcode string"
    got = {r["line_id"]: r["root"] for r in split.line_groups(scratch, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"L1": "L1", "L2": "L1", "L3": "L1", "L4": "L4", "L5": "L5", "L6": "L4"}
    one = {tuple(r) for r in split.build_split(scratch, spark.createDataFrame(rows, schema)).collect()}
    assert one == {tuple(r) for r in split.build_split(scratch, spark.createDataFrame(rows[::-1], schema)).collect()}
    assert len({r[2] for r in one}) == 3


def test_components_of_a_chain_and_a_hub(spark, scratch):
    from quarry.operators.components import connected_components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(50))
    assert connected_components(scratch, spark.createDataFrame([], "a long, b long")).isEmpty()
