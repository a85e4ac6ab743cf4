"""Packing into sequences whose every window holds the sources in target proportions.

Each source is a queue of tokens. Deficit round-robin gives each queue, in every window, its share of the window's
tokens, and carries what is left of a share (a fraction of a token, here) to the next; a queue that has run out leaves
its share to the others. Served token by token this has a closed form: by the end of window k queue s has been served
min(size_s, weight_s * t_k) tokens, where t_k is the time at which all queues together have been served k windows. So
each document's place follows from the tokens before it in its own queue, which a distributed running total gives, and
deficits carry over windows and partitions alike. The windows are laid end to end and cut into sequences.

Within a window the queues' shares lie one after another, so that a sequence is mostly of one or two sources; it is windows, of
64 sequences, that hold the mixture.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, running_totals
from .tokens import encoder, tokenizer_path

LENGTH = 1024
WINDOW = 64 * LENGTH
#: Queues whose quotas every task holds; sources beyond the largest so many share one more, in the order in which queues of
#: their own would have served them.
QUEUES = 1023
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """Where each token of each queue goes. sizes: tokens of the queues; weights: their target shares, above 0."""

    def __init__(self, sizes: list[int], weights: list[float], window: int = WINDOW):
        self.sizes = np.array(sizes, np.int64)
        w = np.array(weights, float)
        self.total, self.window = int(self.sizes.sum()), window
        self.windows = max(1, -(-self.total // window))
        # What all queues have been served is piecewise linear in time; it bends where a queue runs out.
        ends = self.sizes / w
        order = np.argsort(ends, kind="stable")
        self.t, self.served, self.speed = [0.0], [0.0], [float(w.sum())]
        for i in order:
            self.served.append(self.served[-1] + (ends[i] - self.t[-1]) * self.speed[-1])
            self.t.append(float(ends[i]))
            self.speed.append(max(0.0, self.speed[-1] - w[i]))
        self.w = w
        self.kept: dict[int, np.ndarray] = {}

    def quota(self, k: int) -> np.ndarray:
        """Tokens that each queue has been served before window k."""
        if k >= self.windows:
            return self.sizes
        if k <= 0:
            return np.zeros_like(self.sizes)
        if k not in self.kept:
            if len(self.kept) > 10_000:
                self.kept.clear()
            goal = float(k) * self.window
            i = max(0, int(np.searchsorted(self.served, goal, side="right")) - 1)
            t = self.t[i] + (goal - self.served[i]) / self.speed[i] if self.speed[i] > 0 else self.t[i]
            self.kept[k] = np.minimum(self.sizes, np.floor(self.w * t * (1 + 1e-15)).astype(np.int64))
        return self.kept[k]

    def place(self, s: int, u: int, n: int):
        """(from, to, position) of the pieces of tokens u to u + n of queue s, in its own count; one for each window."""
        at = u
        lo, hi = 0, self.windows  # the window of u: the last k with quota(k)[s] <= u
        guess = int(u / max(1, int(self.sizes[s])) * self.windows)
        for k in (guess - 1, guess, guess + 1):
            if 0 < k < self.windows:
                if self.quota(k)[s] <= u:
                    lo = max(lo, k)
                else:
                    hi = min(hi, k)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.quota(mid)[s] <= u:
                lo = mid
            else:
                hi = mid
        k = lo
        while at < u + n:
            q, r = self.quota(k), self.quota(k + 1)
            if r[s] > at:
                end = min(int(r[s]), u + n)
                yield at, end, int(q.sum() + (r - q)[:s].sum() + at - q[s])
                at = end
            k += 1


def tokenized(docs: DataFrame, folder_table, key: str, text: str, source: str, tokenizer: str, end_id: int) -> DataFrame:
    """Per document its ids (of 2 or 4 bytes) and their number, and the tokens before it in its source within its partition (pid)."""

    def encode(batches):
        from pyspark import TaskContext

        pid, enc, carry = TaskContext.get().partitionId(), encoder(tokenizer), {}
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                sources = b.column(2).to_pylist()
                ids, n, before = [], [], []
                for i, x in enumerate(enc.ids(b.column(1).to_pylist())):
                    x = np.frombuffer(x + end, "<u4")
                    ids.append((x.astype("<u2") if x.max() < 1 << 16 else x).tobytes())
                    n.append(len(x))
                    before.append(carry.get(sources[i], 0))
                    carry[sources[i]] = before[-1] + n[-1]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([pid] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "pid", "before", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.concat(F.when(F.col(source).isNull(), "~").otherwise("="), F.coalesce(F.col(source), F.lit(""))).alias("source"))
    return folder_table(rows.mapInArrow(encode, "doc_id long, source string, pid int, before long, n long, ids binary"))


def pack(scratch: Scratch, docs: DataFrame, targets: dict[str | None, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, window: int = WINDOW, queues: int = QUEUES) -> DataFrame:
    """Packs every document, with end_id after it, into sequences of `length`; gives the pieces (see PIECES).

    targets: weight of each source (null by None); else its share of all tokens, so that every window has the mixture of
    the whole. Sources without a weight, and those beyond the `queues` largest, share a queue, weighted by its tokens, in which
    each document comes at the share of its own source that is before it: every one of them is spread over the queue evenly.
    All sequences but the last are full. Null texts are empty (end_id alone); repeated rows are packed each; null sources
    are a source of their own. Queues are in the order in which the table is stored.
    """
    spark = docs.sparkSession
    with arrow_rows(spark):
        rows = tokenized(docs, lambda d: scratch.table(d, "ids", "zstd"), key, text, source, tokenizer or tokenizer_path(), end_id)
    sums = scratch.table(rows.groupBy("pid", "source").agg(F.sum("n").alias("n")), "sums")
    named = {("~" if k is None else f"={k}"): float(v) for k, v in (targets or {}).items() if v > 0}
    sizes = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is not None:
        sizes = sizes.where(F.col("source").isin(list(named)))
    top = [tuple(r) for r in sizes.orderBy(F.desc("n"), "source").limit(queues).collect()]  # bounded
    whole = int(sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rest = whole - sum(n for _, n in top)
    top.sort()
    weights = [named.get(s, 0.0) if targets is not None else float(n) for s, n in top]
    tokens = [n for _, n in top]
    if rest:
        tokens.append(rest)
        weights.append(rest / whole * (sum(weights) or 1.0) if targets is not None else float(rest))
    queue_of = scratch.table(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(top)], "source string, queue int"), "queues")
    # Earlier tokens of the same source: in earlier partitions, and in the own partition, which the row knows.
    base = running_totals(scratch, sums.select("pid", "source", "n"), ["source"], ["pid"], ["n"]).select("pid", "source", F.col("start_n").alias("base"))
    base = scratch.table(base.join(queue_of, "source", "left"), "bases")
    placed = rows.join(base, ["pid", "source"]).withColumn("at", F.col("before") + F.col("base"))
    if rest:
        # Documents of the shared queue in order of their place in their own source; ties by name and partition.
        size = sums.groupBy("source").agg(F.sum("n").alias("size"))
        time = (F.col("at").cast("double") / F.col("size")).alias("time")
        shared = placed.where("queue is null").select("pid", "source", "before", "at", "n").join(size, "source").select("pid", "source", "before", "n", time, F.lit(0).alias("g"))
        order = running_totals(scratch, shared, ["g"], ["time", "source", "pid"], ["n"]).select("pid", "source", "before", F.col("start_n").alias("shared_at"))
        placed = placed.join(order, ["pid", "source", "before"], "left").withColumn("at", F.coalesce("shared_at", "at"))
    plan = Schedule(tokens, weights, window) if tokens else None

    def cut(batches):
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            out: list = []
            for doc, s, u, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "at", "n", "ids"))):
                merged: list[list[int]] = []
                raw = np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) < 4 * n else raw
                for f, t, pos in plan.place(s, u, n):
                    while f < t:
                        e = min(t, f + length - pos % length)
                        if merged and merged[-1][2] + merged[-1][1] - merged[-1][0] == pos and pos % length:
                            merged[-1][1] = e
                        else:
                            merged.append([f, e, pos])
                        pos, f = pos + e - f, e
                for f, e, pos in merged:
                    out.append((doc, f - u, e - f, zlib.crc32(raw[(f - u) * 4 : (e - u) * 4]), n, pos // length, pos % length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], [x.split()[0] for x in PIECES.split(", ")])

    return placed.select("doc_id", F.coalesce("queue", F.lit(len(top))).alias("queue"), "at", "n", "ids").mapInArrow(cut, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in the mixture of the whole table; see pack()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(Scratch(spark, "op6"), docs)


def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, whole, empty): whether the pieces of op6_packing() make up each document's tokens, end to end, and whether
    these are the end id alone. doc_ids are unique here."""
    pieces = op6_packing(spark, sf_dir)
    ends = F.sum(F.col("start") + F.col("length")) - F.sum("start")
    whole = (ends == F.max("doc_tokens")) & (F.min("start") == 0) & (F.max(F.col("start") + F.col("length")) == F.max("doc_tokens")) & (F.count_distinct("start") == F.count("*")) & (F.min("length") > 0)
    return pieces.groupBy("doc_id").agg(whole.alias("whole"), (F.max("doc_tokens") == 1).alias("empty"))


TOKENS_ORACLE = "SELECT doc_id, true AS whole, coalesce(text, '') = '' AS empty FROM documents"
