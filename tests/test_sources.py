"""Readers and writers."""

import gzip
import hashlib

import pytest

from quarry.sources import files


def test_csv_keeps_zeros_blanks_and_marks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿line_id,tenant,customer_id,order_date,raw_text,gt_item_code,more\n001,t,,2026-01-01,\"a, \"\"b\"\"\",,x\n".encode())
    lines, labels = files.read_order_lines(spark, str(p), labelled=True)
    r = lines.first()
    assert (r["line_id"], r["customer_id"], r["raw_text"], r["notes"]) == ("001", "", 'a, "b"', "") and "more" not in lines.columns
    assert labels.first()["label"] == ""


def test_bad_csv(spark, tmp_path):
    for text in ("a,a\n1,2\n", "b\n1\n"):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(ValueError):
            files.read_csv(spark, str(tmp_path / "b.csv"), ["a"])
    (tmp_path / "c.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "c.csv"), ["a"]).collect()
    (tmp_path / "d.csv").write_text("line_id,tenant,customer_id,order_date,raw_text\n1,t,c,d,x\n1,t,c,d,x\n")
    with pytest.raises(ValueError):
        files.read_order_lines(spark, str(tmp_path / "d.csv"))


def test_catalogue(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_catalogue(spark, f"file://{tmp_path}")
    (tmp_path / "catalogue_acme.csv").write_text("item_code,item_name,disabled,barcode\n01,Disc,0,007\n")
    (tmp_path / "catalogue_nordic.csv").write_text("item_code,item_name,disabled\n01,Milk,1\n")
    got = {(r["tenant"], r["item_code"], r["item_name"], r["barcode"]) for r in files.read_catalogue(spark, f"file://{tmp_path}").collect()}
    assert got == {("acme", "01", "Disc", "007"), ("nordic", "01", "Milk", "")}
    (tmp_path / "catalogue_acme.csv").write_text("item_code,item_name,disabled\n01,Disc,2\n")
    with pytest.raises(ValueError):
        files.read_catalogue(spark, f"file://{tmp_path}")


def test_aliases_policy_golden_manifest(spark, tmp_path):
    assert files.read_aliases(spark, "nowhere", cold_start=True).isEmpty()
    (tmp_path / "p.json").write_text('{"enabled_buckets": ["identifier"], "buckets": {"identifier": {"n": 15, "correct": 15, "probability": 0.94, "wilson95": [0.8, 1]}, "blocked": {"n": 2, "correct": 1, "probability": 0.5}}}')
    assert {(r["bucket"], r["enabled"], r["probability"]) for r in files.read_policy(spark, f"file://{tmp_path}/p.json").collect()} == {("identifier", True, 0.94), ("blocked", False, 0.5)}
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        f.write('[{"a": 1}, {"a": 2}]')
    assert files.read_golden(spark, f"file://{tmp_path}/g.json.gz", "a long").count() == 2
    r = files.manifest(spark, f"file://{tmp_path}/p.json").first()
    assert r["sha256"] == hashlib.sha256((tmp_path / "p.json").read_bytes()).hexdigest()


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([("L1", "A", 0.98275862, "auto", "lexical_other", [("A", 0.875), ("B", 0.5)]), ("L2", "", 0.0, "review", "empty_text", [])], "line_id string, item_code string, confidence double, decision string, reason_code string, candidates array<struct<item_code:string,score:double>>")
    files.write_predictions(df.orderBy("line_id"), f"file://{tmp_path}/out", single=True)
    text = next(p for p in (tmp_path / "out").iterdir() if p.name.endswith(".csv")).read_text()
    assert text == "line_id,item_code,confidence,decision,reason_code,candidates\nL1,A,0.98275862,auto,lexical_other,A:0.87500000|B:0.50000000\nL2,,0.00000000,review,empty_text,\n"
