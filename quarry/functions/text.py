"""Text functions of the matcher as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are expanded before tokens are taken, in this order.
EXPANSIONS = (
    (r"(?U)\bss(?=\s*\d)", "stainless "),
    (r"(?U)\bsds\b", "self drilling screw"),
    (r"(?U)(?<!\d)/|/(?!\d)", " "),
    (r"(?U)\bz\s*\.\s*p\.?\b", "zinc plated"),
    (r"(?U)\bzp\b", "zinc plated"),
    (r"(?U)\bs\s*/?\s*s\b", "stainless"),
    (r"(?U)\bskru\b", "screw"),
    (r"(?U)\bayam\b", "chicken"),
    (r"(?U)\bsusu\b", "milk"),
)
#: What counts as a token, a quantity, a request beyond one item, an identifier, a number.
TOKEN = r"(?U)\d+/\d+|\d+(?:\.\d+)?|[a-z]+"
QUANTITY = r"(?U)(\d+/\d+|\d+(?:\.\d+)?)\s*(mm|cm|inch|kg|g|ml|l)\b"
COMPLEX = r"\b(not|except|instead|or)\b"
IDENTIFIER_TOKEN = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
NUMBER = r"(?U)\d+(?:[./]\d+)?"
#: Dimension and factor to mm, g or ml of each unit.
UNITS = {"mm": ("length", 1.0), "cm": ("length", 10.0), "inch": ("length", 25.4), "kg": ("weight", 1000.0), "g": ("weight", 1.0), "ml": ("volume", 1.0), "l": ("volume", 1000.0)}
#: The words of each categorical attribute.
CATEGORIES = {
    "colour": r"\b(red|blue|brown|white|black|yellow|green)\b",
    "grade": r"\bclass ([a-z])\b",
    "disc_kind": r"\b(grinding|cutting|flap)\b",
    "material": r"\b(stainless|zinc plated|brass|pvc|hdg)\b",
    "steel_grade": r"\bstainless (304|316|410)\b",
}
ATTRIBUTES = ("colour", "disc_kind", "grade", "length", "material", "steel_grade", "volume", "weight")
#: What can be seen of noise, by name.
NOISE = {
    "pack_word": r"(?iU)\b(?:ctn|carton|box|case|pack|packet)\b",
    "dimension_or_weight_token": "(?iU)\\d\\s*(?:mm|cm|kg|inch|\"|″)",
    "selected_malay_word": r"(?iU)\b(?:skru|ayam|susu)\b",
}
#: Texts that ask for no item.
NON_ITEMS = ("delivery charge", "delivery fee", "opening balance")


def casefold(c: Column) -> Column:
    """Lower case; sharp s becomes ss. Other full case foldings are left as lower case has them."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalise(c: Column) -> Column:
    """Units and abbreviations spelled out, then only fractions, decimals and letter runs, joined by one space."""
    t = casefold(c)
    for mark in ("″", '"', "''"):
        t = F.replace(t, F.lit(mark), F.lit(" inch "))
    for pattern, word in EXPANSIONS:
        t = F.regexp_replace(t, pattern, word)
    return F.array_join(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), " ")


def word_key(c: Column) -> Column:
    """Case-folded words of any script, joined by one space; what the split groups texts by."""
    return F.array_join(F.regexp_extract_all(casefold(c), F.lit(r"(?U)\w+"), F.lit(0)), " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def trigrams(c: Column) -> Column:
    """Every three characters in a row of the text between two spaces."""
    t = F.concat(F.lit(" "), c, F.lit(" "))
    return F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def counts(items: Column) -> Column:
    """A map from each item of an array to how often it occurs."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("k"), F.size(F.filter(items, lambda y: y == x)).cast("long").alias("v"))))


def square(m: Column) -> Column:
    """The sum of squares of a map of counts."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, v: s + v * v)


def cosine(a: Column, b: Column, a_square: Column | None = None, b_square: Column | None = None) -> Column:
    """Of two maps of counts; 0 where either is empty. All sums are of integers, so their order does not matter."""
    na, nb = square(a) if a_square is None else a_square, square(b) if b_square is None else b_square
    zero = F.lit(0).cast("long")
    dot = F.aggregate(F.map_keys(a), zero, lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), zero))
    return ratio_of_norms(dot, na, nb)


def ratio_of_norms(dot: Column, a_square: Column, b_square: Column) -> Column:
    return F.coalesce(F.try_divide(dot.cast("double"), F.sqrt(a_square * b_square)), F.lit(0.0))


def bag(items: Column) -> Column:
    """An array as what bag_cosine() is quick on: its distinct items, the counts above 1, and the sum of squares of all counts."""
    s = F.array_sort(items)
    # Items that repeat stand next to themselves in order.
    pairs = F.arrays_zip(s.alias("a"), F.slice(s, 2, F.greatest(F.size(items), F.lit(1))).alias("b"))
    twice = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["a"] == p["b"]), lambda p: p["a"]))
    count = F.transform(twice, lambda k: F.struct(k.alias("k"), F.size(F.filter(items, lambda y: y == k)).cast("long").alias("v")))
    # Without repeats, as texts mostly are, nothing is sorted or counted.
    none = F.size(F.array_distinct(items)) == F.size(items)
    more = F.map_from_entries(F.when(none, F.slice(count, 1, 0)).otherwise(count))
    size = F.size(F.array_distinct(items)).cast("long")
    square = F.when(none, size).otherwise(F.aggregate(F.map_values(more), size, lambda t, v: t + v * v - 1))
    return F.struct(F.array_distinct(items).alias("keys"), more.alias("more"), square.alias("square"))


def gram_key(g: Column) -> Column:
    """Three characters as one number: 21 bits hold any of them."""
    at = lambda i: F.ascii(F.substring(g, i, F.lit(1))).cast("long")
    return F.shiftleft(at(F.lit(1)), 42).bitwiseOR(F.shiftleft(at(F.lit(2)), 21)).bitwiseOR(at(F.lit(3)))


def bag_cosine(a: Column, b: Column) -> Column:
    """The same cosine from two bags: shared keys are counted by hashing, and counts above 1 make up the rest."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    count = lambda x, k: F.coalesce(F.try_element_at(x["more"], k), one)
    own = F.aggregate(F.map_keys(a["more"]), zero, lambda s, k: s + F.when(F.array_contains(b["keys"], k), count(a, k) * count(b, k) - 1).otherwise(zero))
    its = F.aggregate(F.map_keys(b["more"]), zero, lambda s, k: s + F.when(F.array_contains(a["keys"], k) & F.try_element_at(a["more"], k).isNull(), count(b, k) - 1).otherwise(zero))
    shared = F.size(F.array_intersect(a["keys"], b["keys"])).cast("long")
    dot = F.when((F.size(a["more"]) == 0) & (F.size(b["more"]) == 0), shared).otherwise(shared + own + its)
    return ratio_of_norms(dot, a["square"], b["square"])


def attributes(t: Column) -> Column:
    """Of normalised text: a struct of sorted distinct values by attribute, null where there are none. Lengths are in mm, weights in g, volumes in ml."""
    values = F.regexp_extract_all(t, F.lit(QUANTITY), F.lit(1))
    units = F.regexp_extract_all(t, F.lit(QUANTITY), F.lit(2))
    number = lambda v: F.try_divide(F.get(F.split(v, "/"), F.lit(0)).cast("double"), F.coalesce(F.get(F.split(v, "/"), F.lit(1)), F.lit("1")).cast("double"))
    factor = F.create_map(*(F.lit(x) for u, (_, f) in UNITS.items() for x in (u, f)))
    both = F.zip_with(values, units, lambda v, u: F.struct(u.alias("u"), F.round(number(v) * F.element_at(factor, u), 6).alias("v")))
    some = lambda a: F.when(F.size(a) > 0, F.array_sort(F.array_distinct(a)))
    out = {k: some(F.regexp_extract_all(t, F.lit(p), F.lit(1))) for k, p in CATEGORIES.items()}
    for d in ("length", "weight", "volume"):
        own = [u for u, (k, _) in UNITS.items() if k == d]
        out[d] = some(F.transform(F.filter(both, lambda s: s["u"].isin(own) & s["v"].isNotNull()), lambda s: s["v"]))
    return F.struct(*(out[k].alias(k) for k in ATTRIBUTES))


def conflicts(requested: Column, offered: Column) -> Column:
    """Names of attributes that both have with different values, sorted."""
    pick = lambda k: F.when(requested[k].isNotNull() & offered[k].isNotNull() & (requested[k] != offered[k]), F.lit(k))
    return F.array_compact(F.array(*(pick(k) for k in ATTRIBUTES)))


def without_words(text: Column, literals: Column) -> Column:
    """The text with every whole-word occurrence of the literals, longest first, made a space."""
    by_length = F.array_sort(literals, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quote = lambda v: F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.aggregate(by_length, text, lambda t, v: F.regexp_replace(t, quote(v), F.lit(" ")))


def noise_flags(raw_text: Column, uom_text: Column, buyer_sku: Column, raw_barcode: Column) -> Column:
    """What can be seen of an order line's noise; `other` if nothing."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(
        F.array(
            flag((buyer_sku != "") | (raw_barcode != ""), "structured_identifier"),
            *(flag((F.concat(raw_text, F.lit(" "), uom_text) if name == "pack_word" else raw_text).rlike(pattern), name) for name, pattern in NOISE.items()),
            flag(raw_text.contains("/") | raw_text.contains("  "), "separator_or_spacing"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))
