"""What a line keeps of a tile of items: scores by the postings of its terms, conflicts, pack families, the best candidates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterable

import numpy as np
import pyarrow as pa

FLOOR, TOP = 0.25, 3
TOKEN_WEIGHT, GRAM_WEIGHT, IDENTIFIED = 0.55, 0.45, 0.99
#: A tenant's lines and items are dealt by hash into blocks of about so many. A tile is a block of lines and one of items.
TILE_LINES, TILE_ITEMS = 2048, 8192
KEY = ["tenant", "line_block", "item_block"]
TILE_SCHEMA = "line_id string, codes array<string>, scores array<double>, exact long, kin long, offers array<boolean>, text_conflict boolean, pack_conflict boolean"
_ARROW = pa.schema([("line_id", pa.string()), ("codes", pa.list_(pa.string())), ("scores", pa.list_(pa.float64())), ("exact", pa.int64()), ("kin", pa.int64()), ("offers", pa.list_(pa.bool_())), ("text_conflict", pa.bool_()), ("pack_conflict", pa.bool_())])
#: Lines that share a text or what they ask for share the work on it; of so many of these the results are kept at a time.
KEPT = 64


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def _trigrams(text: str) -> list[str]:
    t = f" {text} "
    return [t[i : i + 3] for i in range(len(t) - 2)]


class Postings:
    """Cosines of bags with every text, from the texts that each term is in."""

    def __init__(self, texts: list[str], terms):
        self.terms, self.n = terms, len(texts)
        bags = [Counter(terms(t)) for t in texts]
        self.square = np.array([sum(c * c for c in b.values()) for b in bags], np.float64)
        lists: dict[str, tuple[list[int], list[int]]] = {}
        for i, b in enumerate(bags):
            for term, c in b.items():
                at, count = lists.setdefault(term, ([], []))
                at.append(i)
                count.append(c)
        self.lists = {k: (np.array(at), np.array(count, np.float64)) for k, (at, count) in lists.items()}

    def cosines(self, text: str) -> np.ndarray:
        bag = Counter(self.terms(text))
        met = [(c, *self.lists[t]) for t, c in bag.items() if t in self.lists]
        if not met:
            return np.zeros(self.n)
        dot = np.bincount(np.concatenate([at for _, at, _ in met]), np.concatenate([k if c == 1 else k * c for c, _, k in met]), self.n)
        return np.divide(dot, np.sqrt(sum(c * c for c in bag.values()) * self.square), out=np.zeros(self.n), where=dot > 0)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 8 decimals as Spark has it: halves, of the decimals that a double is written with, go up."""
    at = x * 1e8
    out = np.floor(at + 0.5) / 1e8
    for i in np.flatnonzero(np.abs(at - np.floor(at) - 0.5) < 1e-4):
        out[i] = _half_up(float(x[i]))
    return out


def _half_up(x: float) -> float:
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("1e-8"), ROUND_HALF_UP))


def _numbers(values: Iterable[Hashable]) -> tuple[np.ndarray, dict]:
    """Values as numbers from 0 in order of appearance; none is -1."""
    of: dict = {}
    return np.array([-1 if v is None else of.setdefault(v, len(of)) for v in values], np.int64), of


def _pack_families(family: Iterable, bulk: Iterable, packs: Iterable) -> tuple[np.ndarray, int]:
    """Numbers of the families that differ by Bulk and in their packs, -1 for other items, and how many there are."""
    kinds, with_bulk = {}, set()
    for f, b, p in zip(family, bulk, packs, strict=True):
        if p is not None:
            kinds.setdefault(f, set()).add(p)
        if b:
            with_bulk.add(f)
    of, numbers = _numbers(f if f in with_bulk and len(kinds.get(f, ())) > 1 else None for f in family)
    return of, len(numbers)


class Items:
    """A tile's items in order of their codes; those of one code in an order that does not hang on how they came."""

    def __init__(self, t: pa.Table):
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("code", "name", "attributes", "brand", "family", "bulk", "packs")), strict=True), key=lambda r: (r[0], repr(r)))
        code, name, attributes, brand, family, bulk, packs = zip(*rows, strict=True) if rows else ((),) * 7
        self.code, self.size = code, len(code)
        self.code_of, self.codes = _numbers(code)
        self.of_code: dict[str, list[int]] = {}
        for i, c in enumerate(code):
            self.of_code.setdefault(c, []).append(i)
        self.name_of, self.names = _numbers(name)
        self.brand_of, self.brands = _numbers(brand)
        columns = list(zip(*attributes, strict=True)) if attributes else []
        self.attributes = [_numbers(c) for c in columns]
        self.offers = [[v is not None for v in a] for a in attributes]
        self.bulk = np.array(bulk, bool)
        self.family_of, self.families = _pack_families(family, bulk, packs)
        self.packed = self.family_of >= 0
        self.any_bulk, self.any_other = (self._families(self.packed & b) for b in (self.bulk, ~self.bulk))
        texts = list(self.names)
        self.words, self.grams = Postings(texts, _words), Postings(texts, _trigrams)

    def _families(self, rows: np.ndarray) -> np.ndarray:
        """Which families have one of these rows."""
        out = np.zeros(self.families, bool)
        out[self.family_of[rows]] = True
        return out

    def blend(self, query: str) -> np.ndarray:
        return (TOKEN_WEIGHT * self.words.cosines(query) + GRAM_WEIGHT * self.grams.cosines(query))[self.name_of]

    def bad(self, requested: tuple, mentioned: tuple) -> np.ndarray:
        """Items that conflict with what is requested."""
        out = np.zeros(self.size, bool)
        for value, (have, known) in zip(requested, self.attributes, strict=False):
            if value is not None:
                out |= (have >= 0) & (have != known.get(value, -2))
        if mentioned:
            out |= ~np.isin(self.brand_of, [self.brands[b] for b in mentioned if b in self.brands])
        return out

    def packs(self, asked: frozenset, sole: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Items that their families leave, and families that leave none or are asked for as both."""
        any_chosen = np.ones(self.families, bool)
        chosen = np.ones(self.size, bool)
        if len(asked) == 1:
            chosen = self.bulk == ("bulk" in asked)
            any_chosen = self.any_bulk if "bulk" in asked else self.any_other
        at = [i for i in self.of_code.get(sole, ()) if self.packed[i]] if sole is not None else []
        if at:
            own = self._families(np.array(at))
            is_sole = np.zeros(self.size, bool)
            is_sole[at] = True
            chosen = chosen & (is_sole | ~self.packed | ~own[self.family_of])
            any_chosen = np.where(own, self._families(np.array([i for i in at if chosen[i]], np.int64)), any_chosen)
        return chosen, ~any_chosen | (len(asked) > 1)

    def kept(self, line: dict, blend: np.ndarray, bad: np.ndarray) -> tuple:
        """The row of TILE_SCHEMA for one line, after its id."""
        identified = [i for c in line["codes"] for i in self.of_code.get(c, ())]
        score = blend
        if identified:
            score = blend.copy()
            score[identified] = np.maximum(score[identified], IDENTIFIED)
        left = ~bad
        pack_conflict = False
        if self.families:
            asked = frozenset(w for w in ("bulk", "standard") if w in (line["query"] or "").split(" "))
            chosen, stuck = self.packs(asked, line["codes"][0] if line["clean"] else None)
            if stuck.any():
                pack_conflict = bool((left & self.packed & stuck[self.family_of] & (score >= FLOOR)).any())
            if not chosen.all():
                met = self._families(left & self.packed)
                out = self.packed & ~chosen & (met & ~stuck)[self.family_of]
                # An item's siblings leave by their codes, wherever these occur.
                left &= ~(out if len(self.codes) == self.size else np.isin(self.code_of, self.code_of[out]))
        at = np.flatnonzero(left & (score >= FLOOR))
        if len(at) > TOP:
            own = score[at]
            at = at[own >= np.partition(own, len(own) - TOP)[len(own) - TOP]]
        best = at[np.argsort(-score[at], kind="stable")][:TOP]
        same = self.names.get(line["query"])
        exact = 0 if same is None else int(np.count_nonzero(left & (self.name_of == same)))
        kin = offers = None
        if len(best):
            family = self.family_of[best[0]]
            kin = int(np.count_nonzero(left & (self.family_of == family))) if family >= 0 else 0
            offers = self.offers[best[0]]
        return [self.code[i] for i in best], score[best].tolist(), exact, kin, offers, bool(bad[identified].any()), pack_conflict


def tile(lines: pa.Table, items: pa.Table) -> pa.Table:
    """Rows of TILE_SCHEMA, one for each line."""
    its = Items(items)
    # Lines alike in text or requests come together, so few results are kept at a time.
    rows = sorted(lines.select(["line_id", "query", "attributes", "mentioned", "codes", "clean"]).to_pylist(), key=lambda r: r["query"] or "")
    conflicts: dict[tuple, np.ndarray] = {}
    out, text, blend = [], None, None
    for r in rows:
        if blend is None or (r["query"] or "") != text:
            text = r["query"] or ""
            blend = rounded(its.blend(text))
        asked = (tuple(r["attributes"]), tuple(r["mentioned"]))
        if asked not in conflicts:
            if len(conflicts) >= KEPT:
                conflicts.clear()
            conflicts[asked] = its.bad(*asked)
        out.append((r["line_id"], *its.kept(r, blend, conflicts[asked])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)] if out else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)
