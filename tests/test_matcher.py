"""Identifier and lexical evidence, packs, specifications, decisions and their contract."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import decision, evaluation, identifiers, lexical
from quarry.plans.queries import QUERIES
from quarry.sources.files import ALIAS_COLUMNS, LINE_COLUMNS

from .conftest import SF

CAT = ("tenant", "item_code", "item_name", "disabled", "barcode", "description", "brand", "stock_uom", "uom_conversions")


def catalogue(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c, "0" if c == "disabled" else "") for c in CAT) for r in rows], ", ".join(f"{c} string" for c in CAT))


def lines(spark, *rows):
    base = {"tenant": "acme", "customer_id": "C1", "order_date": "2026-02-01"}
    return spark.createDataFrame([tuple(({"line_id": f"L{i}"} | base | r).get(c, "") for c in LINE_COLUMNS) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in LINE_COLUMNS))


def aliases(spark, *rows):
    base = {"tenant": "acme", "customer_id": "C1", "valid_from": "", "valid_to": "", "source": "confirmed_order", "confidence": "1"}
    return spark.createDataFrame([tuple((base | r)[c] for c in ALIAS_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in ALIAS_COLUMNS))


def item(code, name, tenant="acme", **more):
    return {"tenant": tenant, "item_code": code, "item_name": name} | more


def rows(df, key="line_id"):
    return [r.asDict(recursive=True) for r in df.orderBy(key).collect()]


def test_normalise(spark):
    cases = {"S/S screw": "stainless screw", '3/4"': "3/4 inch", "SS304": "stainless 304", 'Remax/Ball/Valve/2"/SS304': "remax ball valve 2 inch stainless 304", "z.p. bolt": "zinc plated bolt", "ZP": "zinc plated", "SDS": "self drilling screw", "skru ayam susu": "screw chicken milk", "": "", "Straße 5.0": "strasse 5.0"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.normalise(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == cases


def test_attributes(spark):
    df = spark.createDataFrame([('Pipe 3/4" red class b PVC',), ("milk 1.5 l, 2 kg, 30 cm",), ("bolt 1/0 mm SS304 cutting",), ("",)], "t string").withColumn("n", X.normalise(F.col("t")))
    a, b, c, d = (r[0].asDict() for r in df.select(X.attributes(F.col("n"))).collect())
    assert a["length"] == [19.05] and a["colour"] == ["red"] and a["grade"] == ["b"] and a["material"] == ["pvc"]
    assert b["volume"] == [1500.0] and b["weight"] == [2000.0] and b["length"] == [300.0] and b["material"] is None
    assert c["length"] is None and c["steel_grade"] == ["304"] and c["disc_kind"] == ["cutting"]
    assert all(v is None for v in d.values())


def test_trigrams_and_cosine(spark):
    df = spark.createDataFrame([("ab", "ab"), ("", "ab"), ("a b", "c d")], "a string, b string")
    got = df.select(X.trigrams(F.col("a")), X.cosine(X.counts(X.words(F.col("a"))), X.counts(X.words(F.col("b"))))).collect()
    assert [r[0] for r in got] == [[" ab", "ab "], [], [" a ", "a b", " b "]]
    assert [r[1] for r in got] == [1.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def known(spark):
    cat = catalogue(spark, item("A", 'Flap Disc 5"', barcode="00123"), item("B", 'Flap Disc 7"', barcode="00999"), item("OFF", "Gone", disabled="1"), item("N", "Milk", "nordic", barcode="00888"))
    return cat, aliases(spark, {"customer_sku": "CUSTOM", "item_code": "B", "valid_from": "2026-01-01"}, {"customer_sku": "OLD", "item_code": "A", "valid_to": "2026-01-31"}, {"customer_sku": "WEAK", "item_code": "A", "source": "inferred_match"}, {"customer_sku": "BACK", "item_code": "A", "valid_from": "2026-03-01", "valid_to": "2026-02-01"})


def test_identifiers(spark, scratch, known):
    cat, al = known
    asked = lines(
        spark,
        {"raw_text": "00123"},
        {"raw_text": "123"},
        {"raw_text": "A 00999"},
        {"raw_text": "x", "raw_barcode": "00888"},
        {"raw_text": "x", "buyer_sku": "CUSTOM"},
        {"raw_text": "x", "buyer_sku": "OLD"},
        {"raw_text": "x", "buyer_sku": "WEAK"},
        {"raw_text": "x", "buyer_sku": "BACK"},
        {"raw_text": "x", "buyer_sku": "NONE"},
        {"raw_text": "OFF"},
        {"raw_text": "A", "tenant": "mars"},
        {"raw_text": "A 9 mm"},
        {"raw_text": "x", "buyer_sku": "CUSTOM", "order_date": "soon"},
        {"raw_text": "x", "buyer_sku": "OLD", "order_date": "2026-01-31"},
    ).withColumn("line_id", F.lpad(F.substring("line_id", 2, 2), 2, "0"))
    got = rows(identifiers.retrieve_identifiers(scratch, asked, cat, al))
    want = [
        (["A"], ["barcode"], []),
        ([], [], []),
        (["A", "B"], ["barcode", "item_code"], ["identifier_conflict"]),
        ([], [], ["unresolved_explicit_barcode"]),
        (["B"], ["buyer_alias"], []),
        ([], [], ["no_date_valid_alias"]),
        (["A"], ["buyer_alias"], ["untrusted_alias_metadata"]),
        ([], [], ["invalid_alias_dates", "no_date_valid_alias"]),
        ([], [], ["unresolved_buyer_sku"]),
        ([], ["item_code"], ["ineligible_identifier_target"]),
        ([], [], ["unknown_tenant"]),
        (["A"], ["item_code"], ["numeric_text_conflict_or_unparsed_quantity"]),
        ([], [], ["invalid_order_date"]),
        (["A"], ["buyer_alias"], []),
    ]
    assert [(r["codes"], r["sources"], r["issues"]) for r in got] == want


def matched(spark, scratch, cat, al, *asked, exhaustive=False):
    ls = lines(spark, *asked)
    ev = identifiers.retrieve_identifiers(scratch, ls, cat, al)
    return rows(lexical.retrieve(scratch, ls, cat, ev, exhaustive))


def test_lexical(spark, scratch):
    cat = catalogue(spark, item("A", 'Stallion Flap Disc 5"', brand="Stallion"), item("B", 'Stallion Flap Disc 7"', brand="Stallion"), item("C", 'Remax Flap Disc 5"', brand="Remax"), item("D", "Blue rod", barcode="777"), item("E", "Blue rod"), item("X", 'Stallion Flap Disc 5"', "nordic"))
    got = matched(spark, scratch, cat, None, {"raw_text": 'Stalion flap disc 5"'}, {"raw_text": 'Stallion flap disc 7"'}, {"raw_text": "blue rod"}, {"raw_text": "delivery fee"}, {"raw_text": "??"}, {"raw_text": "B flap disc 5 inch"}, {"raw_text": "zzz"}, {"raw_text": "remax disc"})
    codes = [[c["code"] for c in r["candidates"]] for r in got]
    assert codes[0][0] == "A" and "B" not in codes[0]
    assert codes[1] == ["B"] and got[1]["exact_unique"]
    assert codes[2] == ["D", "E"] and "ambiguous_exact_names" in got[2]["issues"] and "small_candidate_margin" in got[2]["issues"]
    assert got[3]["issues"] == ["not_an_item"] and got[4]["issues"] == ["empty_text"]
    assert "identifier_text_conflict" in got[5]["issues"]
    assert got[6]["issues"] == ["no_candidate_above_floor"] and got[6]["candidates"] == []
    assert codes[7] == ["C"] and "missing_length" in got[7]["issues"]


def test_index_finds_what_scoring_everything_finds(spark, scratch):
    cat = catalogue(spark, *(item(f"I{i}", f"{a} {b} {n} mm", brand=("X", "Y")[i % 2]) for i, (a, b, n) in enumerate((a, b, n) for a in ("red", "blue", "steel") for b in ("bolt", "bolts", "gizmo") for n in (5, 10))))
    asked = [{"raw_text": t} for t in ("red bolt 5mm", "blu bolt", "gizm", "stel blt 10", "I3", "x red", "not blue gizmo 10 mm")]
    assert matched(spark, scratch, cat, None, *asked) == matched(spark, scratch, cat, None, *asked, exhaustive=True)


def test_packs(spark, scratch):
    pack = lambda n: f'[{{"uom":"carton","conversion_factor":{n}}}]'
    cat = catalogue(spark, item("S", "Screw M4", stock_uom="Nos", uom_conversions=pack(10), barcode="111"), item("B", "Screw M4 (Bulk)", stock_uom="Nos", uom_conversions=pack(144)), item("T", "Nail", stock_uom="Nos"))
    got = matched(spark, scratch, cat, None, {"raw_text": "Screw M4", "qty": "50"}, {"raw_text": "Screw M4 bulk"}, {"raw_text": "Screw M4 standard"}, {"raw_text": "Screw M4", "raw_barcode": "111"}, {"raw_text": "Screw M4 bulk standard"}, {"raw_text": "bulk Screw M4", "raw_barcode": "111"})
    codes = [[c["code"] for c in r["candidates"]] for r in got]
    assert "ambiguous_pack" in got[0]["issues"]
    assert codes[1] == ["B"] and codes[2] == ["S"] and codes[3] == ["S"]
    assert all("ambiguous_pack" not in got[i]["issues"] for i in (1, 2, 3))
    assert "pack_evidence_conflict" in got[4]["issues"] and "pack_evidence_conflict" in got[5]["issues"]


def test_specifications(spark, scratch):
    cat = catalogue(spark, item("H", "Bolt M8x50 HDG", barcode="5551"), item("Z", "Bolt M8x50 Stainless 304"))
    got = matched(spark, scratch, cat, None, {"raw_text": "Bolt M8x50"}, {"raw_text": "Bolt M8x50 HDG"}, {"raw_text": "Bolt M8x50", "raw_barcode": "5551"}, {"raw_text": "Bolt M8x50 SS304"}, {"raw_text": "Bolt M8x50 not HDG"})
    assert "missing_material" in got[0]["issues"]
    assert got[1]["candidates"][0]["code"] == "H" and "missing_material" not in got[1]["issues"]
    assert got[2]["candidates"][0]["code"] == "H" and "missing_material" not in got[2]["issues"]
    assert got[3]["candidates"][0]["code"] == "Z"
    assert "complex_request" in got[4]["issues"]


def test_decisions(spark, scratch):
    cat = catalogue(spark, item("A", "Blue rod", barcode="123456"))
    policy = spark.createDataFrame([("identifier", True, 0.94), ("lexical_exact", False, 0.7)], "bucket string, enabled boolean, probability double")
    ls = lines(spark, {"raw_text": "Blue rod", "raw_barcode": "123456"}, {"raw_text": "Blue rod"}, {"raw_text": "Blue rod", "tenant": "mars"}, {"raw_text": "Blue rod", "raw_barcode": "9"}, {"raw_text": "delivery charge"})
    out = decision.match(scratch, ls, cat, policy)
    got = rows(out)
    assert [(r["item_code"], r["decision"], round(r["confidence"], 4), r["reason_code"]) for r in got] == [("A", "auto", 0.94, "identifier_verified"), ("", "review", 0.7, "lexical_exact"), ("", "review", 0.0, "unknown_tenant"), ("", "review", 0.0, "unresolved_explicit_barcode"), ("", "reject", 0.0, "not_an_item")]
    assert [len(r["candidates"]) for r in got] == [1, 1, 0, 1, 0]
    assert decision.violations(out, ls, cat).isEmpty()
    assert decision.same_rows(out, decision.match(scratch, ls, cat, policy)).isEmpty()
    assert {r["reason_code"] for r in rows(decision.review_only(ls, cat))} == {"baseline_review", "unknown_tenant"}


def test_contract(spark):
    cat = catalogue(spark, item("A", "disc"), item("OFF", "disc", disabled="1"), item("X-OLD", "disc"), item("F", " delivery fee "), item("N", "milk", "nordic"))
    ls = lines(spark, *({"raw_text": "x"} for _ in range(9)))
    c = lambda *p: [(code, float(s)) for code, s in p]
    bad = [("N", 0.5, "auto", "ok", c(("N", 1))), ("OFF", 0.5, "auto", "ok", c(("OFF", 1))), ("", float("nan"), "review", "ok", []), ("A", 0.5, "review", "ok", c(("A", 1))), ("", 0.5, "maybe", "ok", []), ("", 0.5, "review", "Not ok", c(("A", 0.1), ("A", 0.1))), ("", 0.5, "review", "ok", c(("X-OLD", 2), ("F", 0.5))), ("A", 0.5, "auto", "ok", []), ("A", 1.0, "auto", "ok", c(("A", 1)))]
    results = spark.createDataFrame([(f"L{i}", *r) for i, r in enumerate(bad)], "line_id string, item_code string, confidence double, decision string, reason_code string, candidates array<struct<item_code:string,score:double>>")
    got = {r["line_id"]: r["broken"] for r in rows(decision.violations(results, ls, cat))}
    assert got == {"L0": ["ineligible_item", "ineligible_candidate"], "L1": ["ineligible_item", "ineligible_candidate"], "L2": ["confidence_range"], "L3": ["auto_needs_code"], "L4": ["unknown_decision"], "L5": ["reason_token", "duplicate_candidates"], "L6": ["ineligible_candidate", "score_range"], "L7": ["item_not_first"]}


def test_contract_by_rows_and_known_tenants(spark):
    """Rows of one line_id are judged each on its own, and results that know their tenant need no lines."""
    cat = catalogue(spark, item("A", "disc"), item("N", "milk", "nordic"))
    some = [("L0", "acme", "A", 0.5, "auto", "ok", [("A", 1.0)]), ("L0", "acme", "N", 0.5, "auto", "ok", [("N", 1.0)]), ("L1", "nordic", "N", 2.0, "auto", "ok", [("N", 1.0), ("A", 0.5)]), ("L2", None, "", 0.5, "review", "ok", [("A", 1.0)]), ("L3", "acme", "", 0.5, "review", "ok", None)]
    results = spark.createDataFrame(some, "line_id string, tenant string, item_code string, confidence double, decision string, reason_code string, candidates array<struct<item_code:string,score:double>>")
    got = [(r["line_id"], r["broken"]) for r in rows(decision.violations(results, None, cat))]
    assert got == [("L0", ["ineligible_item", "ineligible_candidate"]), ("L1", ["confidence_range", "ineligible_candidate"]), ("L2", ["ineligible_candidate"])]


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


RETRIEVAL = "line_id string, tenant string, codes array<string>, candidates array<struct<code:string,score:double>>, issues array<string>, exact_unique boolean, margin double"


def exchanges(df):
    """What each exchange that deals lines out by their ids carries."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [x for x in plan.split("\n\n") if "Exchange\n" in x and "hashpartitioning(line_id" in x]


def test_decisions_move_no_line(spark, no_broadcast):
    """The codes come beside the candidates: with a join of evidence every candidate went through a shuffle once more."""
    r = spark.createDataFrame([("L0", "t", ["A"], [("A", 0.95)], [], True, 0.9), ("L1", "t", None, [], [], False, 0.0)], RETRIEVAL)
    policy = spark.createDataFrame([("identifier", True, 0.94)], "bucket string, enabled boolean, probability double")
    out = decision.decide(r, None, policy)
    assert not exchanges(out)
    assert exchanges(decision.decide(r, r.select("line_id", "codes"), policy))
    assert [(x["line_id"], x["item_code"]) for x in rows(out)] == [("L0", "A")]


def test_proposals_meet_labels_without_candidates(spark, no_broadcast):
    r = spark.createDataFrame([("L0", "t", [], [("A", 0.9), ("B", 0.7)], [], True, 0.2), ("L1", "t", [], [("A", 0.9)], ["x"], True, 0.9), ("L2", "t", [], [("A", 1.0)], [], True, 0.01), ("L3", "t", [], [("A", 0.8)], [], True, 0.8), ("L4", "t", [], [], [], False, 0.0)], RETRIEVAL)
    labels = spark.createDataFrame([(f"L{i}", x) for i, x in enumerate(("A", "A", "A", "B", ""))], "line_id string, label string")
    got = evaluation.proposal_curve(r, labels=labels)
    assert exchanges(got) and not any("candidates" in x or "issues" in x for x in exchanges(got))
    assert [(x["threshold"], x["proposed"], x["correct"]) for x in rows(got, "threshold")] == [(0.6, 2, 1), (0.7, 2, 1), (0.8, 2, 1), (0.85, 1, 1), (0.9, 1, 1), (0.95, 0, 0), (1.0, 0, 0)]
    assert rows(evaluation.proposal_curve(r.join(labels, "line_id")), "threshold") == rows(got, "threshold")


def test_contract_in_parts(spark, monkeypatch):
    sizes = []
    violations = decision.violations
    monkeypatch.setattr(decision, "violations", lambda r, *a: sizes.append(r.count()) or violations(r, *a))
    assert QUERIES["match_contract"](spark, SF).count()
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert sum(sizes) == 2 * n and max(sizes) < n
