"""Jobs from files to files."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.operators.report import match_health
from quarry.plans import jobs
from quarry.sources.ledger import ledger


def data(tmp_path):
    (tmp_path / "catalogue_acme.csv").write_text("item_code,item_name,disabled,barcode,brand\n" + "".join(f"I{i},{w} rod {i} mm,0,{1000 + i},B\n" for i, w in enumerate(["blue", "red", "green", "steel", "brass"] * 4)))
    (tmp_path / "customer_sku_map.csv").write_text("tenant,customer_id,customer_sku,item_code,valid_from,valid_to,source,confidence\nacme,C1,S1,I1,,,confirmed_order,1\n")
    head = "line_id,tenant,customer_id,order_date,raw_text,buyer_sku,raw_barcode,gt_item_code\n"
    rows = [f"L{i:02d},acme,C1,2026-01-01,{w} rod {i} mm,,{1000 + i if i % 2 else ''},I{i}\n" for i, w in enumerate(["blue", "red", "green", "steel", "brass"] * 4)]
    (tmp_path / "train.csv").write_text(head + "".join(rows) + "L98,acme,C1,2026-01-01,delivery fee,,,\nL99,acme,C1,2026-01-01,?,S1,,\n")
    (tmp_path / "policy.json").write_text(json.dumps({"enabled_buckets": ["identifier", "lexical_exact"], "buckets": {"identifier": {"n": 9, "correct": 9, "probability": 0.9}, "lexical_exact": {"n": 9, "correct": 9, "probability": 0.9}}}))
    return f"file://{tmp_path}"


def test_predict_and_evaluate(spark, tmp_path):
    d = data(tmp_path)
    got = {r["line_id"]: r for r in jobs.predict(spark, d, f"{d}/train.csv", f"{d}/policy.json", f"{d}/out").collect()}
    assert got["L03"]["item_code"] == "I3" and got["L03"]["reason_code"] == "identifier_verified" and got["L98"]["decision"] == "reject"
    assert sum(1 for p in (tmp_path / "out" / "manifest").glob("*.json") for _ in p.open()) == 4
    rows, lines = jobs.evaluated(spark, d, f"{d}/train.csv")
    assert rows.count() == 22 and set(r[0] for r in rows.select("partition").distinct().collect()) <= {"development", "validation"}
    from quarry.sources.files import read_policy

    m = jobs.measured(rows, lines, read_policy(spark, f"{d}/policy.json"))
    top = m["summary"].where("scope = 'overall'").first()
    assert top["lines"] == 22 and top["wrong_auto"] == 0 and top["auto"] >= 10 and m["wrong"].isEmpty()
    assert jobs.fit(rows).count() >= 1


def test_fit_then_predict_then_gates(spark, tmp_path):
    """Each command reads what the one before has written."""
    from quarry.sources.files import read_policy, read_split

    d = data(tmp_path)
    main(["split", "--train", f"{d}/train.csv", "--out", f"{d}/split"])
    assert read_split(spark, f"{d}/split").count() == 22
    main(["fit", "--data", d, "--train", f"{d}/train.csv", "--out", f"{d}/fitted", "--split", f"{d}/split"])
    policy = {r["bucket"]: r for r in read_policy(spark, f"{d}/fitted").collect()}
    assert policy["no_candidate"]["probability"] == 0 and not policy["no_candidate"]["enabled"] and policy["identifier"]["n"] == policy["identifier"]["correct"] > 0
    main(["predict", "--data", d, "--lines", f"{d}/train.csv", "--policy", f"{d}/fitted", "--out", f"{d}/out"])
    assert spark.read.option("header", True).csv(f"{d}/out/predictions").count() == 22
    main(["evaluate", "--data", d, "--train", f"{d}/train.csv", "--policy", f"{d}/fitted", "--out", f"{d}/eval", "--split", f"{d}/split"])
    assert spark.read.json(f"{d}/eval/all/summary").where("scope = 'overall'").first()["lines"] == 22
    main(["audit", "--data", d, "--out", f"{d}/audit"])
    gates = lambda: {r["gate"]: r for r in jobs.released(spark, d, f"{d}/train.csv", f"{d}/fitted", f"{d}/audit/files", f"{d}/split", 1).collect()}
    got = gates()
    assert len(got) == 10 and all(r["value"] is not None for n, r in got.items() if n.split()[0] in ("ece", "brier", "warm_p95_ms", "stale_files"))
    assert got["stale_files ="]["passed"]
    (tmp_path / "customer_sku_map.csv").write_text((tmp_path / "customer_sku_map.csv").read_text() + "acme,C2,S2,I2,,,confirmed_order,1\n")
    assert gates()["stale_files ="]["value"] == 1
    with pytest.raises(SystemExit):  # not 114 lines
        main(["gates", "--data", d, "--train", f"{d}/train.csv", "--policy", f"{d}/fitted", "--manifest", f"{d}/audit/files", "--out", f"{d}/gates", "--split", f"{d}/split", "--repeat", "1"])
    (tmp_path / "other.json").write_text('{"line_id": "L00", "partition": "validation", "group": "x"}\n')
    with pytest.raises(ValueError):
        jobs.evaluated(spark, d, f"{d}/train.csv", split_path=f"{d}/other.json")


def test_check_command(spark, tmp_path, capsys):
    d = f"file://{tmp_path}"
    main(["ledger", "--out", f"{d}/ledger", "--lines", "300"])
    of = ["--data", f"{d}/ledger", "--first", "2026-04-28", "--last", "2026-05-31"]
    main(["baseline", *of, "--out", f"{d}/golden"])
    main(["check", *of, "--golden", f"{d}/golden", "--budget", "60", "--repeat", "1", "--strict"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["passed"]
    golden = spark.read.parquet(f"{d}/golden")
    golden.withColumn("position", -F.col("position")).write.parquet(f"{d}/backwards")
    golden.withColumn("avg_latency_ms", F.col("avg_latency_ms") + 1e-9).write.parquet(f"{d}/near")
    for other, differing, out_of_order in (("backwards", False, True), ("near", True, False)):
        with pytest.raises(SystemExit):
            main(["check", *of, "--golden", f"{d}/{other}", "--budget", "60", "--repeat", "1", "--strict"])
        got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert (got["differing_rows"] > 0, got["rows_out_of_order"] > 0) == (differing, out_of_order)
    main(["check", *of, "--golden", f"{d}/near", "--budget", "60", "--repeat", "1"])  # to six places they are equal
    main(["explain", *of])
    assert "Physical Plan" in capsys.readouterr().out
    t = [spark.read.parquet(f"{d}/ledger/{n}") for n in ("tenants", "order_lines", "events", "items")]
    assert list(jobs.by_channel(spark, t, "2026-05-01", "2026-05-02", 60)) == [1, 2, 3, 4]


def test_commands(spark, tmp_path):
    d = data(tmp_path)
    main(["split", "--train", f"{d}/train.csv", "--out", f"{d}/split"])
    main(["audit", "--data", d, "--out", f"{d}/audit"])
    main(["ledger", "--out", f"{d}/ledger", "--lines", "200"])
    main(["report", "--data", f"{d}/ledger", "--first", "2026-05-01", "--last", "2026-06-30", "--out", f"{d}/report"])
    assert spark.read.json(f"{d}/split").count() == 22
    assert spark.read.json(f"{d}/audit/catalogue").first()["rows"] == 20
    assert spark.read.parquet(f"{d}/report").count() > 0


def test_check_and_ablation(spark):
    g = ledger(spark, lines=100)
    make = lambda names=None: match_health(g["tenants"], g["order_lines"], g["events"], g["items"], "2026-05-01", "2026-05-10", names)
    got = jobs.check(spark, make, make(), budget=60, repeat=1)
    assert got["equal"] and got["within_budget"]
    assert not jobs.check(spark, make, make().limit(1), budget=60, repeat=1)["equal"]
    times = jobs.ablation(spark, make, limit=60)
    assert len(times) == 10 and all(times.values())
    assert jobs.timed(spark, spark.range(10**13).selectExpr("sum(id % 7)"), limit=1.0) is None
