"""Lexical evidence: blended cosines of lines and items, conflicts, pack families, the best candidates of each line.

Pairs of a line and an item stay within a task: lines and items meet in tiles of a tenant (tiles.py), and only what a line
keeps of a tile's items leaves it. So what is written grows with lines and items rather than with their pairs.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scratch import Scratch, partitions, spread
from .catalogue import completed, eligible
from .identifiers import identifier_index
from .tiles import FLOOR, GRAM_WEIGHT, IDENTIFIED, KEY, TILE_ITEMS, TILE_LINES, TILE_SCHEMA, TOKEN_WEIGHT, TOP, tile

CLOSE = 0.05
#: Runs of up to so many words are found by a pattern each. Shapes are told apart by so many numbers.
NEAR, SIEVE = 8, 4096
LETTERS = string.ascii_letters
BY = ["tenant", "brand", "stem", "uom"]


def _none():
    return F.array().cast("array<string>")


def prepared_items(catalogue: DataFrame) -> DataFrame:
    """Eligible items: name, attributes, brand, and the family of their packs."""
    cat = completed(catalogue).where(eligible())
    name = X.normalise(F.col("item_name"))
    packs = F.from_json(F.when(F.col("uom_conversions") == "", "[]").otherwise(F.col("uom_conversions")), "array<struct<uom:string,conversion_factor:double>>")
    signature = F.to_json(F.array_sort(F.transform(packs, lambda p: F.struct(X.casefold(p["uom"]).alias("u"), p["conversion_factor"].alias("f")))))
    items = cat.select("tenant", F.col("item_code").alias("code"), name.alias("name"), X.normalise(F.col("brand")).alias("brand"), X.casefold(F.col("stock_uom")).alias("uom"), signature.alias("packs"))
    bulk = F.array_contains(X.words(F.col("name")), "bulk")
    return items.select("*", X.attributes(F.col("name")).alias("offered"), bulk.alias("bulk"), F.trim(F.regexp_replace("name", r"\bbulk\b", "")).alias("stem"))


def pack_families(items: DataFrame) -> DataFrame:
    """(tenant, brand, stem, uom) of items that differ by Bulk and in their packs."""
    return items.groupBy(*BY).agg(F.count("*").alias("n"), F.bool_or("bulk").alias("any"), F.count_distinct("packs").alias("kinds")).where("n > 1 and any and kinds > 1").select(*BY)


def _spans(text: Column, most: int, word: str, gap: str) -> Column:
    """Runs of up to so many words with what is between them. Patterns find the short ones; those of more words are cut out one by one."""
    some = [F.regexp_extract_all(text, F.lit(rf"(?U)(?=({word}+(?:{gap}+{word}+){{{k}}})){word}+"), F.lit(1)) for k in range(min(most, NEAR))]
    if most > NEAR:
        seg = F.regexp_extract_all(text, F.lit(rf"(?U){word}+|{gap}+"), F.lit(0))
        first = F.when(F.get(seg, F.lit(0)).rlike(rf"(?U)^{word}"), 0).otherwise(1)
        run = lambda i, k: F.when((F.pmod(i - first, F.lit(2)) == 0) & (i + 2 * k < F.size(seg)), F.array_join(F.slice(seg, i + 1, 2 * k + 1), ""))
        some.append(F.flatten(F.transform(F.sequence(F.lit(NEAR), F.lit(most - 1)), lambda k: F.array_compact(F.transform(seg, lambda _, i: run(i, k))))))
    return F.concat(*some)


def _sieve(values: DataFrame, value: str, words: Column) -> tuple[int, Callable[[Column], Column]]:
    """The most words of a value, and a test that no value fails: by its shape's number, as letters and digits are told apart only
    from each other. What looks like no value is not looked up; where all numbers occur, everything is."""
    number = lambda v: F.pmod(F.xxhash64(F.translate(v, LETTERS + "0123456789", "a" * len(LETTERS) + "9" * 10)), F.lit(SIEVE)).cast("int")
    rows = values.groupBy(number(F.col(value)).alias("n")).agg(F.max(words).alias("words")).collect()
    seen = [r["n"] for r in rows]
    return max([1, *(r["words"] for r in rows)]), lambda v: number(v).isin(seen) if seen else F.lit(False)


def query_features(scratch: Scratch, lines: DataFrame, catalogue: DataFrame, sources: list[DataFrame] | None = None) -> DataFrame:
    """Lines with the normalised text, attributes of the text without known identifiers, and brands in it.

    sources: gets the tables that these are read from, which may go once they are written."""
    cat = completed(catalogue)
    # Runs of words with what is between them, as many as the longest identifier has: any identifier that stands alone is
    # one of them, but for marks before and after it. One that is found so and is not there itself is removed from nothing.
    index = identifier_index(cat).select("tenant", "value", F.regexp_extract("value", r"(?Us)\w(?:.*\w)?", 0).alias("run")).distinct().where("run <> ''")
    index = scratch.table(index, "identifiers")
    brands = scratch.table(cat.where("brand <> ''").select("tenant", X.normalise(F.col("brand")).alias("b")).where("b <> ''").distinct(), "brands")
    longest, like_identifier = _sieve(index, "run", F.regexp_count("value", F.lit(r"(?U)\w+")))
    most, like_brand = _sieve(brands, "b", F.size(F.split("b", " ")))
    sieved = lambda spans, like: F.array_distinct(F.filter(spans, like))
    base = lines.select("line_id", "tenant", "raw_text", X.normalise(F.col("raw_text")).alias("query"))
    base = base.select("*", sieved(_spans(F.col("raw_text"), longest, r"\w", r"\W"), like_identifier).alias("runs"), sieved(_spans(F.col("query"), most, "[^ ]", " "), like_brand).alias("phrases"))
    base = scratch.table(base, "texts")
    if sources is not None:
        sources += [base, index, brands]
    some = lambda c, name: base.where(F.size(c) > 0).select("line_id", "tenant", F.explode(c).alias(name))
    found = some("runs", "run").join(index, ["tenant", "run"]).groupBy("line_id").agg(F.collect_set("value").alias("known"))
    mentioned = some("phrases", "b").join(brands, ["tenant", "b"]).groupBy("line_id").agg(F.collect_set("b").alias("mentioned"))
    bare = X.normalise(X.without_words(F.col("raw_text"), F.coalesce("known", _none())))
    out = base.drop("runs", "phrases").join(found, "line_id", "left").join(mentioned, "line_id", "left").withColumn("bare", bare)
    return out.select("line_id", "tenant", "query", X.attributes(F.col("bare")).alias("requested"), F.coalesce("mentioned", _none()).alias("mentioned"))


def _attributes(c: str) -> Column:
    """Each attribute's values as one text, null where there are none."""
    return F.array(*(F.array_join(F.col(c)[k].cast("array<string>"), "|") for k in X.ATTRIBUTES)).alias("attributes")


def by_tiles(scratch: Scratch, queries: DataFrame, items: DataFrame) -> DataFrame:
    """What each line keeps of its tenant's items, as TILE_SCHEMA has it."""
    blocks = lambda rows, most, name: rows.groupBy("tenant").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # Written, so that Spark knows it to be small before it moves lines or items to it.
    sizes = scratch.table(blocks(queries, TILE_LINES, "line_blocks").join(blocks(items, TILE_ITEMS, "item_blocks"), "tenant"), "sizes")
    number = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    clean = (F.size("codes") == 1) & (F.size("issues") == 0)
    left = queries.join(sizes, "tenant").select("tenant", number("line_blocks", "line_id").alias("line_block"), each("item_blocks").alias("item_block"), "line_id", "query", _attributes("requested"), "mentioned", "codes", clean.alias("clean"))
    # What may be a family stays whole, so that its tile knows all siblings and whether it is one.
    right = items.join(sizes, "tenant").select("tenant", each("line_blocks").alias("line_block"), number("item_blocks", "brand", "stem", "uom").alias("item_block"), "code", "name", _attributes("offered"), "brand", F.when(F.col("stem").isNotNull(), F.struct("brand", "stem", "uom").cast("string")).alias("family"), "bulk", "packs")
    # Short rows and long work: dealt out by number, as sizes would put many tiles into one task.
    dealt = lambda rows: rows.repartition(partitions(rows.sparkSession), *KEY).groupBy(*KEY)
    found = scratch.table(dealt(left).cogroup(dealt(right)).applyInArrow(tile, TILE_SCHEMA), "tiles")
    first = F.when(F.size("scores") > 0, F.struct(-F.get("scores", F.lit(0)), F.get("codes", F.lit(0)), "kin", "offers"))
    top = F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("codes").alias("c"))))
    return found.groupBy("line_id").agg(
        F.transform(F.slice(F.array_sort(top), 1, TOP), lambda t: F.struct(t["c"].alias("code"), (-t["s"]).alias("score"))).alias("top"),
        F.sum("exact").alias("exact"),
        F.min_by("kin", first).alias("kin"),
        F.min_by("offers", first).alias("offers"),
        F.bool_or("text_conflict").alias("text_conflict"),
        F.bool_or("pack_conflict").alias("pack_conflict"),
    )


def all_pairs(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Every item of the line's tenant."""
    return queries.select("line_id", "tenant").join(items.select("tenant", "code"), "tenant")


def scored(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with score and conflicts; of pack siblings also the family."""
    bags = lambda rows, text, *names: rows.withColumns({names[0]: X.bag(X.words(F.col(text))), names[1]: X.bag(F.transform(X.trigrams(F.col(text)), X.gram_key))})
    j = pairs.join(bags(queries, "query", "qwords", "qgrams"), ["line_id", "tenant"]).join(bags(items, "name", "words", "grams"), ["tenant", "code"])
    identified = F.array_contains("codes", F.col("code"))
    blend = TOKEN_WEIGHT * X.bag_cosine(F.col("qwords"), F.col("words")) + GRAM_WEIGHT * X.bag_cosine(F.col("qgrams"), F.col("grams"))
    brand = F.when((F.size("mentioned") > 0) & ~F.array_contains("mentioned", F.col("brand")), F.array(F.lit("brand"))).otherwise(_none())
    bad = F.array_sort(F.concat(X.conflicts(F.col("requested"), F.col("offered")), brand))
    score = F.round(F.when(identified, F.greatest(blend, F.lit(IDENTIFIED))).otherwise(blend), 8)
    family = F.when(F.col("packed"), F.struct(*BY))
    exact = F.col("name") == F.col("query")
    offers = F.array(*(F.col("offered")[k].isNotNull() for k in X.ATTRIBUTES))
    return j.select("line_id", "code", "query", "codes", "issues", score.alias("score"), bad.alias("conflicts"), identified.alias("identified"), exact.alias("exact"), family.alias("family"), offers.alias("offers"))


def by_pairs(scratch: Scratch, queries: DataFrame, items: DataFrame) -> DataFrame:
    """What by_tiles() gives, by a row for every pair of a tenant: what the tiles are tested against."""
    s = scratch.table(scored(all_pairs(queries, items), queries, items), "scored")
    text_conflict = s.where(F.col("identified") & (F.size("conflicts") > 0)).select("line_id").distinct().withColumn("text_conflict", F.lit(True))
    fit = s.where(F.size("conflicts") == 0)
    # Within each line and pack family: which siblings the words and a clean identifier leave.
    asked = F.array_intersect(F.split("query", " "), F.array(F.lit("bulk"), F.lit("standard")))
    clean = (F.size("codes") == 1) & (F.size("issues") == 0)
    sole = F.get("codes", F.lit(0))
    # A clean identifier narrows only its own family; its item need not be among the compatible.
    sib = items.where("packed").select(*BY, "code", F.col("bulk").alias("sbulk"))
    fams = fit.where("family is not null").select("*", "family.*").groupBy("line_id", *BY).agg(F.first(asked).alias("asked"), F.first(clean).alias("clean"), F.first(sole).alias("sole"), F.max("score").alias("best"))
    choice = (F.when(F.size("asked") == 1, F.col("sbulk") == (F.get("asked", F.lit(0)) == "bulk")).otherwise(F.lit(True)))
    each = fams.join(sib, BY).withColumn("chosen", choice)
    w = Window.partitionBy("line_id", *BY)
    own = F.col("clean") & F.coalesce(F.bool_or(F.col("code") == F.col("sole")).over(w), F.lit(False))
    each = each.withColumn("chosen", F.when(own, F.col("chosen") & (F.col("code") == F.col("sole"))).otherwise(F.col("chosen")))
    each = each.withColumn("stuck", ~F.bool_or("chosen").over(w) | (F.size("asked") > 1))
    pack_issue = each.where(F.col("stuck") & (F.col("best") >= FLOOR)).select("line_id").distinct().withColumn("pack_conflict", F.lit(True))
    out_of = each.where(~F.col("stuck") & ~F.col("chosen")).select("line_id", "code")
    left = fit.join(out_of, ["line_id", "code"], "left_anti")
    order = Window.partitionBy("line_id").orderBy(F.desc("score"), "code")
    ranked = left.withColumn("rank", F.row_number().over(order))
    lead = F.first(F.when((F.col("rank") == 1) & (F.col("score") >= FLOOR), F.col("family")), ignorenulls=True).over(Window.partitionBy("line_id"))
    ranked = ranked.withColumn("kin", F.coalesce(F.col("family") == lead, F.lit(False)))
    head = (F.col("rank") <= TOP) & (F.col("score") >= FLOOR)
    per = ranked.groupBy("line_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(head, F.struct("rank", "code", "score")))), lambda t: F.struct(t["code"].alias("code"), t["score"].alias("score"))).alias("top"),
        F.count_if("exact").alias("exact"),
        F.count_if("kin").alias("kin"),
        F.max(F.when(F.col("rank") == 1, F.col("offers"))).alias("offers"),
    )
    return queries.select("line_id").join(per, "line_id", "left").join(text_conflict, "line_id", "left").join(pack_issue, "line_id", "left")


def retrieve(scratch: Scratch, lines: DataFrame, catalogue: DataFrame, evidence: DataFrame, exhaustive: bool = False) -> DataFrame:
    """Per line: candidates (up to three of code and score), issues, exact_unique and margin; its tenant, and the evidence's codes.

    Prepared items and queries are written once, as several later steps read each.
    """
    prepared = scratch.table(prepared_items(spread(catalogue)), "prepared")
    tenants = scratch.table(catalogue.select("tenant").distinct().withColumn("tenant_known", F.lit(True)), "tenants")
    sources: list[DataFrame] = []
    q = query_features(scratch, spread(lines), catalogue, sources).join(tenants, "tenant", "left").join(evidence.select("line_id", "codes", "issues"), "line_id", "left")
    early = F.when(F.col("tenant_known").isNull(), "unknown_tenant").when(F.col("query") == "", "empty_text").when(F.col("query").isin(*X.NON_ITEMS), "not_an_item")
    q = scratch.table(q.withColumn("early", early), "queries")
    scratch.drop(*sources)
    live = q.where("early is null and codes is not null")
    if exhaustive:
        items = prepared.join(pack_families(prepared).withColumn("packed", F.lit(True)), BY, "left").withColumn("packed", F.coalesce("packed", F.lit(False)))
        per = by_pairs(scratch, live, scratch.table(items, "items"))
    else:
        per = by_tiles(scratch, live, prepared)
        scratch.drop(prepared)  # the tiles are written
    asked = F.array(*(F.col("requested")[k].isNotNull() for k in X.ATTRIBUTES)).alias("asked")
    j = q.select("line_id", "tenant", "early", "codes", "issues", asked, F.col("query").rlike(X.COMPLEX).alias("complex")).join(per, "line_id", "left")
    j = j.withColumn("top", F.coalesce("top", F.array().cast("array<struct<code:string,score:double>>")))
    score = lambda i: F.get("top", F.lit(i))["score"]
    margin = F.when(F.size("top") > 1, score(0) - score(1)).when(F.size("top") == 1, score(0)).otherwise(F.lit(0.0))
    has = F.size("top") > 0
    text_conflict = F.coalesce("text_conflict", F.lit(False))
    supported = F.coalesce((F.size("codes") == 1) & (F.size("issues") == 0) & (F.get("codes", F.lit(0)) == F.get("top", F.lit(0))["code"]) & ~text_conflict, F.lit(False))
    missing = [F.when(has & ~supported & F.get("offers", F.lit(i)) & ~F.get("asked", F.lit(i)), F.lit(f"missing_{k}")) for i, k in enumerate(X.ATTRIBUTES)]
    found = F.array_compact(
        F.array(
            F.when(F.col("text_conflict"), "identifier_text_conflict"),
            F.when(F.col("pack_conflict"), "pack_evidence_conflict"),
            F.when(has & (F.col("kin") > 1), "ambiguous_pack"),
            F.when(F.col("exact") > 1, "ambiguous_exact_names"),
            F.when(~has, "no_candidate_above_floor"),
            F.when(has & (margin < CLOSE), "small_candidate_margin"),
            F.when(has & F.col("complex"), "complex_request"),
            *missing,
        )
    )
    issues = F.when(F.col("early").isNotNull(), F.array("early")).otherwise(F.array_sort(F.array_distinct(F.concat(found, F.col("issues")))))
    return j.select(
        "line_id",
        "tenant",
        "codes",
        F.col("top").alias("candidates"),
        issues.alias("issues"),
        (F.col("early").isNull() & (F.coalesce("exact", F.lit(0)) == 1)).alias("exact_unique"),
        F.when(F.col("early").isNull(), margin).otherwise(F.lit(0.0)).alias("margin"),
    )
