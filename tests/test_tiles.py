"""Lines and items in tiles: nothing written grows with their pairs, and tiles of any size give what all pairs give."""

import glob
import time

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import identifiers, lexical, tiles
from quarry.plans.scratch import Scratch

from .test_matcher import catalogue, item, lines, rows


def pack(n):
    return f'[{{"uom":"carton","conversion_factor":{n}}}]'


def test_no_table_holds_pairs(spark, scratch):
    cat = catalogue(spark, *(item(f"I{i:02}", f"steel bolt {i} mm") for i in range(40)))
    asked = lines(spark, *({"raw_text": f"steel bolt {i} cm"} for i in range(40)))
    out = lexical.retrieve(scratch, asked, cat, identifiers.retrieve_identifiers(scratch, asked, cat, None))
    assert out.count() == 40
    paths = glob.glob(scratch.base.removeprefix("file://") + "/*")
    assert paths
    for path in paths:
        assert spark.read.parquet("file://" + path).count() <= 80, path


def test_small_tiles_find_what_all_pairs_give(spark, scratch, monkeypatch):
    monkeypatch.setattr(lexical, "TILE_LINES", 2)
    monkeypatch.setattr(lexical, "TILE_ITEMS", 3)
    names = [f"{a} {b} {n} mm{c}" for a in ("red", "steel") for b in ("bolt", "gizmo") for n in (5, 10) for c in ("", " bulk", " bulk bulk")]
    cat = catalogue(spark, *(item(f"I{i:02}", n, brand=("X", "Y")[i // 3 % 2], barcode=f"77{i:02}", stock_uom="Nos", uom_conversions=pack(144 if "bulk" in n else 10)) for i, n in enumerate(names)), item("N", "red bolt 5 mm", "nordic"))
    texts = ("red bolt 5mm", "red bolt 5 mm bulk", "steel gizmo standard", "bulk standard bolt", "blu bolt x", "I04 gizmo", "zzz", "bolt bolt bolt 10", "not red y", "7701")
    asked = lines(spark, *({"raw_text": t} for t in texts), {"raw_text": "red bolt", "raw_barcode": "7700"}, {"raw_text": "red bolt bulk", "raw_barcode": "7700"}, {"raw_text": "red bolt 10 mm", "raw_barcode": "7700"}, {"raw_text": "red bolt", "tenant": "nordic"}, {"raw_text": "red bolt", "tenant": "mars"}).withColumn("raw_text", F.when(F.col("raw_text") != "zzz", F.col("raw_text")))
    ev = identifiers.retrieve_identifiers(scratch, asked, cat, None)
    got = rows(lexical.retrieve(scratch, asked, cat, ev))
    assert got == rows(lexical.retrieve(scratch, asked, cat, ev, exhaustive=True))
    assert {"ambiguous_pack", "pack_evidence_conflict", "identifier_text_conflict"} <= {i for r in got for i in r["issues"] or ()}


def test_scores_are_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(20_000), rng.integers(0, 10**8, 20_000) / 1e8 + 5e-9, np.arange(1024) / 1024, np.arange(512) * 0.45 / 512])
    want = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").orderBy("i").select(F.round("x", 8)).collect()
    assert tiles.rounded(x).tolist() == [r[0] for r in want]


def test_words_unlike_any_identifier_or_brand_are_not_looked_up(spark, scratch):
    cat = catalogue(spark, *(item(f"I-{i:02}", "steel bolt", brand="Acme Co") for i in range(20)))
    asked = lines(spark, *({"raw_text": f"Some of i-{i:02} or the large bolts by acme co please 12 of them"} for i in range(20)))
    got = rows(lexical.query_features(scratch, asked, cat))
    assert all(r["mentioned"] == ["acme co"] for r in got)
    texts = spark.read.parquet(glob.glob(scratch.base.removeprefix("file://") + "/*-texts")[0])
    # Of some 40 runs and 27 phrases of each.
    assert all(len(r["runs"]) <= 3 and len(r["phrases"]) <= 3 for r in texts.collect())


def test_long_and_short_runs_of_words_alike(spark, scratch, monkeypatch):
    cat = catalogue(spark, item("A 5 b", "red bolt"), item("9/9-9", "blue bolt", brand="Big Red Co"), item("Ä1", "nut"), item("(X7)", "nut"))
    asked = lines(spark, *({"raw_text": t} for t in ("red A 5 b cm", "a 5 b 9/9-9 big red co", "Ä1 Ä12 red mm", "--(X7) blue", "", "A 5", "A 5 A 5 b")), {"raw_text": "A 5 b red", "tenant": "mars"})
    got = rows(lexical.query_features(scratch, asked, cat))
    monkeypatch.setattr(lexical, "NEAR", 0)
    assert got == rows(lexical.query_features(scratch, asked, cat))
    assert [r["requested"]["length"] for r in got][0] is None and got[1]["mentioned"] == ["big red co"]


def test_shuffle_files_go_once_a_table_is_written(spark):
    files = lambda: {f.getName() for f in _each(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    out = Scratch(spark, "test", frees=True).table(spark.range(1000).repartition(3).groupBy("id").count())
    assert sum(1 for _ in out.collect()) == 1000
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_items_of_one_code_come_in_one_order(spark):
    row = lambda name, family: {"code": "I1", "name": name, "attributes": [None] * 8, "brand": "", "family": family, "bulk": False, "packs": None}
    some = [row("red nut", "x"), row("nut red", "y"), row("red nut", "y")]
    orders = [tiles.Items(tiles.pa.Table.from_pylist(t)) for t in (some, some[::-1])]
    assert [list(i.names)[n] for i in orders[:1] for n in i.name_of] == [list(i.names)[n] for i in orders[1:] for n in i.name_of]


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]
