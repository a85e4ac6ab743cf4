"""Nearest neighbours by an adaptive dimension scan over inverted lists.

Lists are the cells of centres fitted on a bounded sample; every row is in the list of its nearest centre. Beyond TOPS * TOPS
rows each cell is cut again, by centres of what the sample's rows differ from their cells' centres, so that lists go on
growing in number with the rows. Vectors are turned by a random rotation and scanned in blocks of columns: after each block
a candidate is given up when its partial distance, scaled to all dimensions, exceeds the query's tenth best so far by more
than the hypothesis test allows. What is left is measured on the original vectors. The number of lists to probe is set on
the sample, by where the sample's own neighbours lie. A query's nearest list is scanned first; what it finds bounds the scan
of the others. A list is sent to its queries only, as often as QUERIES of them need it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, sorted_groups
from .vectors import parsed, sample, unpack

K = 10
SAMPLE = 20_000
#: Share of the sample's neighbours whose lists are to be probed.
COVER = 0.985
#: Of the hypothesis test: a true neighbour's partial distance exceeds this bound with a chance that falls as exp(-c e^2).
EPSILON = 2.5
#: Rows of a piece of a list, and queries that meet it in one task.
PIECE, QUERIES = 4096, 10_000
#: Centres of the first and of the second level at most, and cells in which a query looks for lists at first.
TOPS, SUBS, NEAR = 4096, 64, 64


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, up to a term that is the same for each row of x."""
    return (c * c).sum(1)[None] - 2 * x @ c.T


def _centres(x: np.ndarray, n: int, rng) -> np.ndarray:
    c = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(12):
        own = np.argmin(_nearest(x, c), 1)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


class Lists:
    """Centres, and lists by number: that of the cell times the centres of the second level, and the place in these."""

    def __init__(self, x: np.ndarray, rows: int, seed: int = 11, tops: int = TOPS):
        rng = np.random.default_rng(seed)
        n = int(max(1, min(tops, round(math.sqrt(rows)), len(x))))
        self.tops = _centres(x, n, rng)
        subs = int(max(1, min(SUBS, math.sqrt(rows) // tops, len(x))))
        self.subs = np.zeros((1, x.shape[1])) if subs == 1 else _centres(x - self.tops[np.argmin(_nearest(x, self.tops), 1)], subs, rng)
        self.number = n * subs
        self.rotation = np.linalg.qr(rng.normal(size=(x.shape[1],) * 2))[0]
        own, ranks = self.assign(x), []
        for q in rng.permutation(len(x))[:300]:
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            best = np.argpartition(d, min(K, len(x) - 1) - 1)[: min(K, len(x) - 1)] if len(x) > 1 else []
            place = np.empty(self.number, np.int64)
            place[self.order(x[q], n)] = np.arange(self.number)
            ranks += place[own[best]].tolist() if len(best) else []
        self.probes = int(np.quantile(ranks, COVER)) + 1 if ranks else self.number

    def assign(self, x: np.ndarray) -> np.ndarray:
        top = np.argmin(_nearest(x, self.tops), 1)
        return top if len(self.subs) == 1 else top * len(self.subs) + np.argmin(_nearest(x - self.tops[top], self.subs), 1)

    def order(self, q: np.ndarray, cells: int) -> np.ndarray:
        """The lists of the nearest cells in order of nearness."""
        d = _nearest(q[None], self.tops)[0]
        if len(self.subs) == 1:
            return np.argsort(d, kind="stable")
        top = np.argsort(d, kind="stable")[:cells]
        # Squared distances to each cell's second centres: all terms, as cells are compared with each other.
        far = ((q - self.tops[top]) ** 2).sum(1)[:, None] + _nearest(q - self.tops[top], self.subs)
        lists = top[:, None] * len(self.subs) + np.arange(len(self.subs))
        return lists.ravel()[np.argsort(far.ravel(), kind="stable")]

    def probe(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[int]:
        """Lists in order of nearness: so many as fitted, and on until they hold k rows besides the query."""
        for cells in (NEAR, len(self.tops)):
            order = self.order(q, cells)
            held = np.cumsum(sizes[order])
            if len(order) == self.number or (held[-1] > k and len(order) >= self.probes):
                break
        return order[: max(self.probes, int(np.searchsorted(held, k + 1)) + 1)].tolist()


def scan(q: np.ndarray, own: int, x: np.ndarray, turned: np.ndarray, turn: np.ndarray, ids: np.ndarray, rows: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows within `bound`: (distances, ids). turned, turn: the rows and the query, rotated; own: the query's row."""
    dim = x.shape[1]
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    ends = sorted({min(dim, e) for e in (8, 16, 32, dim)})
    for s in range(0, len(x), 256):
        alive = s + np.flatnonzero(rows[s : s + 256] != own)
        part, at = np.zeros(len(alive)), 0
        if np.isfinite(bound):
            for e in ends[:-1]:
                part += ((turned[alive, at:e] - turn[at:e]) ** 2).sum(1)
                keep = part * (dim / e) <= (1 + EPSILON / math.sqrt(e)) ** 2 * bound * bound * (1 + 1e-9)
                alive, part, at = alive[keep], part[keep], e
        if not len(alive):
            continue
        d = np.sqrt(((x[alive] - q) ** 2).sum(1))
        best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[alive]])
        if len(best_d) > k:
            o = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[o], best_i[o]
        if len(best_d) == k:
            bound = min(bound, float(best_d.max()))
    o = np.lexsort((best_i, best_d))[:k]
    return best_d[o], best_i[o]


def search(scratch: Scratch, vectors: DataFrame, query_step: int = 100, k: int = K, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean) of each query's k nearest other rows that are found.

    Queries: rows whose vec_id is divisible by query_step. Ties go to the smaller vec_id. Rows are told apart by a number of
    their own: a query is compared with every row but itself, and rows that repeat a vec_id are rows, and queries, each of
    their own, so that a repeated query_id has as many lists of ranks as rows. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows of null vec_id; shorter vectors count as padded with zeros. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows, dtype, _ = parsed(vectors, key, column)
    rows = scratch.table(rows.where("vec is not null and vec_id is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    few = sample(rows, dtype, SAMPLE)
    if not len(few):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = Lists(few, rows.count())

    def assign(batches):
        for b in batches:
            if b.num_rows:
                own = lists.assign(unpack(b.column(1), dtype)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], ["list", "vec_id", "vec", "row"])

    index = scratch.table(rows.mapInArrow(assign, "list int, vec_id long, vec binary, row long"), "lists")
    sizes = np.zeros(lists.number, np.int64)
    for r in index.groupBy("list").count().collect():  # one row for each list, at most TOPS * SUBS
        sizes[r["list"]] = r["count"]
    queries = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0)
    by = ["list", "piece", "block"]

    def probe(batches):
        # Rank 0 is a query's nearest list.
        for b in batches:
            out: list = []
            for raw in b.column("vec").to_pylist():
                out.append(lists.probe(np.frombuffer(raw, dtype).astype(np.float64), sizes, k))
            if out:
                lens = np.array([len(o) for o in out])
                at = pa.array(np.repeat(np.arange(len(out)), lens))
                each = [pa.array(np.concatenate(out), pa.int32()), pa.array(np.concatenate([np.arange(n) for n in lens]), pa.int32())]
                yield pa.RecordBatch.from_arrays([*each, b.column("row").take(at)], ["list", "at", "row"])

    probes = scratch.table(queries.mapInArrow(probe, "list int, at int, row long"), "probes")
    held = spark.createDataFrame([(int(n), int(-(-sizes[n] // PIECE))) for n in np.flatnonzero(sizes)], "list int, pieces int")

    def run(batches):
        for t in sorted_groups(batches, by):
            t = t.combine_chunks()
            kind = t["kind"].to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut in (0, len(kind)):
                continue
            ids, own, raw, bounds = t["vec_id"].to_numpy(), t["row"].to_numpy(), t["vec"].to_pylist(), t["bound"].to_numpy()
            x = np.frombuffer(b"".join(raw[:cut]), dtype).reshape(cut, -1).astype(np.float64)
            turned = x @ lists.rotation
            out = []
            for i in range(cut, len(kind)):
                q = np.frombuffer(raw[i], dtype).astype(np.float64)
                d, near = scan(q, own[i], x, turned, q @ lists.rotation, ids[:cut], own[:cut], bounds[i], k)
                out.append((np.full(len(d), own[i]), np.full(len(d), ids[i]), near, d))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "query_id", "vec_id", "score"])

    def scan_all(asked: DataFrame, bounded: DataFrame) -> DataFrame:
        """asked: (list, row); bounded: (row, vec_id, vec, bound) of every query."""
        need = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(held, "list")
        need = scratch.table(need, "needed")
        piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece")
        base = index.join(need, "list").select("list", piece, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "row", "vec_id", "vec", F.lit(float("inf")).alias("bound"))
        block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")
        sent = asked.join(need, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), block, F.lit(1).alias("kind"), "row")
        sent = sent.join(bounded, "row").select(*base.columns)
        return base.unionByName(sent).repartition(partitions(spark), *by).sortWithinPartitions(*by, "kind").mapInArrow(run, "row long, query_id long, vec_id long, score double")

    best = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    endless = queries.select("row", "vec_id", "vec", F.lit(float("inf")).alias("bound"))
    begun = scratch.table(best(scan_all(probes.where("at = 0").select("list", "row"), endless)).drop("rank"), "begun")
    bound = begun.groupBy("row").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("bound"))
    bounded = queries.join(bound, "row", "left").select("row", "vec_id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = begun.unionByName(scan_all(probes.where("at > 0").select("list", "row"), bounded))
    return best(found).select("query_id", "rank", "vec_id", "score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 100th vector's 10 nearest among all; see search()."""
    return search(Scratch(spark, "op10"), spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
