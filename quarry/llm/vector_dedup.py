"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a sample: each starts at random and is turned, step by step, so that the signs of the rotated vectors
lie as close to them as they can. A vector's code is the signs under several such rotations; tables take k bits of it each, so
that two codes that differ in fewer bits than there are tables share a whole key in one of them, whatever the bits. Codes that
share a key are compared by the Hamming distance of their first SKETCH bits, and what lies within the radius is ranked again by
the cosine of the original vectors. Codes travel to the tables, vectors only where a code has a neighbour.

Signs are taken about the origin, or, where that makes the tables cheaper, about the mean direction, which balances the bits.
The number of tables and the radius follow from pairs at the least cosine around vectors of the sample: as learned bits tear
some vectors apart more often than others, the tenth of them that fares worst counts, and no pair at all may be missed.

Buckets of any size are cut into tiles, so that no task holds more than two pieces of one. A link that is found in many
tables counts in the first in which its vectors meet. Exact copies are one class throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, partitions, sorted_groups
from .vectors import parsed, sample, unpack

LEAST = 0.95
SAMPLE = 20_000
#: Rows of a piece of a large bucket, and comparisons that cost as much as to deal a row to a table.
TILE, DEAL = 1500, 500
#: Chance that a link at the least cosine meets in no table.
MISS = 1e-6
#: Bits of a table at most, and tables on which their number is tried.
BITS, TRIED = 24, 16
#: Vectors of the sample on which rotations are learned, those around which pairs are tried, and pairs of each.
LEARN_ON, TRIED_ON, PAIRS = 5000, 1500, 8
#: Steps of a rotation's learning; below so many dimensions rotations are drawn alone, as learned ones would be the same.
STEPS, LEARNED = 10, 8
#: Bits of a code that its Hamming distances count.
SKETCH = 128


def rotations(u: np.ndarray, bits: int, rng, mean: np.ndarray | None) -> np.ndarray:
    """Directions (columns) whose signs are the bits. mean: the direction about which bits are to be balanced."""
    out, dim = [], u.shape[1]
    while sum(r.shape[1] for r in out) < bits:
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        some = u[rng.permutation(len(u))[:LEARN_ON]]
        if mean is not None:
            some = some - np.outer(some @ mean, mean)
        for _ in range(STEPS if dim >= LEARNED else 0):
            left, _, right = np.linalg.svd(some.T @ np.where(some @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        out.append(turn if mean is None else turn - np.outer(mean, mean @ turn))
    return np.concatenate(out, axis=1)[:, :bits]


def at_cosine(u: np.ndarray, least: float, rng) -> np.ndarray:
    """For each unit vector one at the least cosine, in a random direction from it."""
    side = rng.normal(size=u.shape)
    side -= (side * u).sum(1, keepdims=True) * u
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    return u * least + np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-9) * math.sqrt(max(0.0, 1 - least * least))


class Codes:
    """Bits, table keys and sketches of unit vectors."""

    def __init__(self, x: np.ndarray, rows: int, least: float = LEAST, seed: int = 7):
        rng = np.random.default_rng(seed)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        tried = np.repeat(u[rng.permutation(len(u))[:TRIED_ON]], PAIRS, axis=0)
        near = at_cosine(tried, least, rng)
        middle = u.mean(0)
        size = float(np.linalg.norm(middle))
        best = None
        for mean in (None, middle / size) if size > 0.1 and u.shape[1] > 2 else (None,):
            turn = rotations(u, TRIED * BITS, rng, mean)
            bits, others = (((v @ turn) >= 0).reshape(len(v), TRIED, BITS) for v in (tried, near))
            # Share of the tables whose first k bits are alike, by vector; the worst tenth counts.
            alike = np.logical_and.accumulate(bits == others, axis=2).mean(1).reshape(-1, PAIRS, BITS).mean(1)
            met = np.sort(alike, axis=0)[: max(1, len(alike) // 10)].mean(0)
            full = bits[::PAIRS] @ (1 << np.arange(BITS, dtype=np.int64))
            for k in range(4, BITS + 1):
                pairs = sum(int((n * (n - 1)).sum()) for t in range(TRIED) for n in [np.unique(full[:, t] & ((1 << k) - 1), return_counts=True)[1]])
                share = max(pairs / (TRIED * max(1, len(full) * (len(full) - 1))), 0.5**k)
                tables = math.ceil(math.log(MISS) / math.log1p(-met[k - 1])) if 0 < met[k - 1] < 1 else 1 if met[k - 1] else 1 << 20
                # Tables, times what a row costs in one: dealing it, and comparing it with those it meets.
                cost = tables * (DEAL + rows * share)
                if best is None or cost < best[0]:
                    best = cost, k, tables, mean
        _, self.bits, self.tables, mean = best
        self.proj = rotations(u, self.tables * self.bits, rng, mean)
        while not (self.keys(tried) == self.keys(near)).any(1).all() and self.tables < 1000:
            more = max(1, self.tables // 4)
            self.proj = np.concatenate([self.proj, rotations(u, more * self.bits, rng, mean)], axis=1)
            self.tables += more
        #: Tables whose keys a sketch holds, and the distance of sketches beyond which no pair lies.
        self.held = max(1, min(self.tables, SKETCH // self.bits))
        apart = (self.unpacked(self.sketches(self.keys(tried))) != self.unpacked(self.sketches(self.keys(near)))).sum(1)
        self.radius = min(self.held * self.bits, math.ceil(max(apart.mean() + 7 * apart.std(), apart.max() + 2 * apart.std())))

    def keys(self, u: np.ndarray) -> np.ndarray:
        out = np.empty((len(u), self.tables), np.int64)
        step = max(1, 4_000_000 // self.proj.shape[1])
        for s in range(0, len(u), step):
            bits = (u[s : s + step] @ self.proj >= 0).reshape(-1, self.tables, self.bits)
            out[s : s + step] = bits @ (1 << np.arange(self.bits, dtype=np.int64))
        return out

    def sketches(self, keys: np.ndarray) -> np.ndarray:
        """The bits of the first keys, packed: a row of bytes each."""
        bits = (keys[:, : self.held, None] >> np.arange(self.bits)) & 1
        return np.packbits(bits.reshape(len(keys), -1).astype(np.uint8), axis=1)

    def unpacked(self, sketches: np.ndarray) -> np.ndarray:
        return np.unpackbits(sketches, axis=1, count=self.held * self.bits)


def _met(piece: np.ndarray, a: int, b: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a tile for which near(rows, rows) holds: within its one piece, or between its two."""
    if a == b:
        every = np.arange(len(piece))
        return np.nonzero(np.triu(near(every, every), 1))
    ia, ib = np.flatnonzero(piece == a), np.flatnonzero(piece == b)
    i, j = np.nonzero(near(ia, ib))
    return ia[i], ib[j]


def tile_candidates(codes: Codes, t: pa.Table) -> np.ndarray:
    """Rows of a tile that have a neighbour by Hamming distance which they meet here first, as far as sketches tell."""
    piece = t["piece"].to_numpy()
    table, a, b = (t[c][0].as_py() for c in ("table", "a", "b"))
    bits = codes.unpacked(np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1))
    signs = bits.astype(np.float32) * 2 - 1
    i, j = _met(piece, a, b, lambda p, q: signs[p] @ signs[q].T >= bits.shape[1] - 2 * codes.radius)
    earlier = min(table, codes.held)
    if len(i) and earlier:
        keys = bits.reshape(len(bits), codes.held, codes.bits)[:, :earlier] @ (1 << np.arange(codes.bits))
        first = np.ones(len(i), bool)
        for s in range(0, len(i), 100_000):
            first[s : s + 100_000] = ~(keys[i[s : s + 100_000]] == keys[j[s : s + 100_000]]).any(1)
        i, j = i[first], j[first]
    return np.unique(np.concatenate([i, j]))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that the links reach."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def tile_links(codes: Codes, dtype: str, least: float, t: pa.Table) -> tuple | None:
    """(rep, links first met here, least rep reached) of the rows of one tile that have links. rep names a class of copies."""
    t = t.combine_chunks()
    rep, n, piece = (t[c].to_numpy() for c in ("rep", "n", "piece"))
    order = np.argsort(rep, kind="stable")
    x = unpack(t["vec"].combine_chunks() if isinstance(t["vec"], pa.ChunkedArray) else t["vec"], dtype)[order]
    rep, n, piece = rep[order], n[order], piece[order]
    table, a, b = (t[c][0].as_py() for c in ("table", "a", "b"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = _met(piece, a, b, lambda p, q: u[p] @ u[q].T >= least)
    if not len(i):
        return None
    first = np.ones(len(i), bool)
    if table:
        has = np.unique(np.concatenate([i, j]))
        at = np.zeros(len(rep), np.int64)
        at[has] = np.arange(len(has))
        keys = codes.keys(u[has])[:, :table]
        for s in range(0, len(i), 100_000):
            first[s : s + 100_000] = ~(keys[at[i[s : s + 100_000]]] == keys[at[j[s : s + 100_000]]]).any(1)
    f, g = i[first], j[first]
    links = np.bincount(f, n[g], len(rep)) + np.bincount(g, n[f], len(rep))
    lab = _labels(len(rep), i, j)
    linked = np.zeros(len(rep), bool)
    linked[i] = linked[j] = True
    return rep[linked], links[linked].astype(np.int64), rep[lab[linked]]


def near_vectors(scratch: Scratch, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = LEAST) -> DataFrame:
    """Per row: vec_id, n_links (other rows at cosine >= least), component_id (smallest vec_id reached), kept.

    Vectors that are null, zero or hold null or non-finite components have no links and are kept; shorter vectors count
    as padded with zeros. Rows that repeat a vec_id count one by one. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, dtype, dim = parsed(vectors, key, column)
    rows = scratch.table(rows, "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    few = sample(classes, dtype, SAMPLE)
    if not len(few):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    codes = Codes(few, classes.count(), least)

    def index(batches):
        for b in batches:
            x = unpack(b.column(0), dtype)
            if len(x):
                keys = codes.keys(x / np.linalg.norm(x, axis=1, keepdims=True))
                sketches = [r.tobytes() for r in codes.sketches(keys)]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(keys.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(sketches, pa.binary())], ["rep", "keys", "sketch"])

    coded = scratch.table(classes.select("vec", "rep").mapInArrow(index, "rep long, keys array<int>, sketch binary"), "codes")
    large = coded.select(F.posexplode("keys").alias("table", "bucket")).groupBy("table", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    large = scratch.table(large.select("table", "bucket", F.ceil(F.col("size") / TILE).cast("int").alias("pieces")), "large")
    dealt = coded.select("rep", "sketch", F.posexplode("keys").alias("table", "bucket")).join(large, ["table", "bucket"], "left")
    dealt = dealt.withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("table", "bucket", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), "piece", "rep", "sketch")
    by = ["table", "bucket", "a", "b"]

    def near(batches):
        for t in sorted_groups(batches, by):
            if t.num_rows > 1 and len(own := tile_candidates(codes, t.combine_chunks())):
                yield from t.select([*by, "piece", "rep"]).take(pa.array(own)).combine_chunks().to_batches()

    def link(batches):
        for t in sorted_groups(batches, by):
            if t.num_rows > 1 and (found := tile_links(codes, dtype, least, t)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["rep", "links", "parent"])

    grouped = lambda d: d.repartition(partitions(spark), *by).sortWithinPartitions(*by)
    candidates = scratch.table(grouped(tiles).mapInArrow(near, "table int, bucket int, a int, b int, piece int, rep long"), "candidates")
    found = candidates.join(classes.select("rep", "vec", "n"), "rep")
    found = scratch.table(grouped(found).mapInArrow(link, "rep long, links long, parent long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    members = connected_components(scratch, found.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    named = members.join(classes.select(F.col("rep").alias("node"), "first_id"), "node")
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(firsts, "component").select(F.col("node").alias("rep"), "component_id")
    of_class = classes.join(counts, "rep", "left").join(named, "rep", "left")
    of_class = scratch.table(of_class.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")), "result")
    out = rows.join(of_class, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings; see near_vectors()."""
    return near_vectors(Scratch(spark, "op4"), spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT vec_id, min(t) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.vec_id LEFT JOIN n ON v.vec_id = n.a
"""
