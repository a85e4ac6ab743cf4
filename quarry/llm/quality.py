"""Quality classifier: random-indexing word vectors, pooled for each document, under a two-layer network.

A word is a run of letters, of digits or of other visible characters, as written. Words are hashed to BUCKETS; every
bucket has a fixed sparse random index vector. A word's vector is the sum of the index vectors of its neighbours, up to
two words away on either side, over all occurrences in all documents, brought to unit length, beside its own index
vector. A document is the mean of its words' vectors. The network is fitted on a bounded sample of labelled rows; a
temperature, fitted on labelled rows that the weights never saw, calibrates its probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_rows, forget, partitions, worker_state

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 64, 4, 2
HIDDEN = 32
#: Labelled rows that the network may be fitted on: those whose ids hash least.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Buckets in one row of the sums that partitions send, and partitions whose sums meet first.
SLICE, FAN = 64, 64
#: Bytes of text that are worked on at a time, and documents.
CHUNK, DOCS = 1 << 19, 32
#: Word vectors are multiples of this, so that the sums over up to 8 million words are exact, in whatever order.
GRAIN = 2.0**-30
_ODD = np.uint64(0x9E3779B97F4A7C15)


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero components of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO], rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def _kinds() -> np.ndarray:
    """0 white space, 1 letter or beyond ASCII, 2 digit, 3 other."""
    k = np.full(256, 3, np.uint8)
    k[[9, 10, 11, 12, 13, 32]] = 0
    k[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    k[48:58] = 2
    return k


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_state().setdefault("powers", [np.zeros(0, np.uint64), np.zeros(0, np.uint64)])
    if len(kept[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for i, base in enumerate((_ODD, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            kept[i] = np.multiply.accumulate(p)
    return kept[0], kept[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word of some documents, which are data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kinds()[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    solid = kind[start] != 0
    start, end = start[solid], end[solid]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(50)).astype(np.int64), np.searchsorted(offsets, start, side="right") - 1


def pieces(col: pa.Array):
    """(first row, bytes, offsets) of runs of whole texts of about CHUNK bytes; null texts are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    col = pa.concat_arrays([col])
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] else np.zeros(0, np.uint8)
    s = 0
    while s < len(col):
        e = max(s + 1, int(np.searchsorted(off, off[s] + CHUNK, side="right")) - 1)
        yield s, data[off[s] : off[e]], off[s : e + 1] - off[s]
        s = e


def contexts(scratch: Scratch, docs: DataFrame, text: str = "text") -> np.ndarray:
    """The neighbours' summed index vectors of every bucket, over all documents. Its size does not hang on the input."""
    n = partitions(docs.sparkSession)

    def count(batches):
        from pyspark import TaskContext

        forget("encoders")
        place, sign = index_vectors()
        out = np.zeros(BUCKETS * DIM, np.int64)
        for b in batches:
            for _, data, offsets in pieces(b.column(0)):
                w, d = words(data, offsets)
                at, what = [], []
                for step in range(1, REACH + 1):
                    same = d[step:] == d[:-step]
                    x, y = w[step:][same], w[:-step][same]
                    for k in range(NONZERO):
                        at += [x * DIM + place[y, k], y * DIM + place[x, k]]
                        what += [sign[y, k], sign[x, k]]
                if at:
                    out += np.bincount(np.concatenate(at), np.concatenate(what), BUCKETS * DIM).astype(np.int64)
        yield rows(TaskContext.get().partitionId() // FAN, out)

    def rows(group: int, sums: np.ndarray) -> pa.RecordBatch:
        parts = sums.reshape(-1, SLICE * DIM)
        return pa.RecordBatch.from_arrays([pa.array([group] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["grp", "slice", "sums"])

    def add(batches):
        held: dict = {}
        for b in batches:
            for g, s, raw in zip(*(b.column(c).to_pylist() for c in ("grp", "slice", "sums"))):
                x = np.frombuffer(raw, np.int64)
                held[g, s] = held[g, s] + x if (g, s) in held else x
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["grp", "slice", "sums"])

    schema = "grp int, slice int, sums binary"
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, schema)
    once = some.repartition(n, "grp", "slice").mapInArrow(add, schema)
    whole = once.withColumn("grp", F.lit(0)).repartition(n, "slice").mapInArrow(add, schema)
    out = np.zeros((BUCKETS // SLICE, SLICE * DIM), np.int64)
    with arrow_rows(docs.sparkSession):
        found = whole.select("slice", "sums").collect()  # BUCKETS x DIM numbers, whatever the input
    for r in found:
        out[r["slice"]] += np.frombuffer(r["sums"], np.int64)
    return out.reshape(BUCKETS, DIM)


def word_vectors(context: np.ndarray) -> np.ndarray:
    place, sign = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    np.put_along_axis(own, place, sign / np.sqrt(NONZERO), 1)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    both = np.concatenate([np.where(norm > 0, context / np.maximum(norm, 1e-9), 0), own], 1).astype(np.float32)
    return np.rint(both * np.float32(1 / GRAIN)) * np.float32(GRAIN)


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, then whether it has words.

    The sums are a product: how often each document has each bucket that occurs, times the vectors of these.
    """
    out = np.zeros((len(col), vectors.shape[1] + 1))
    for first, data, offsets in pieces(col):
        w, d = words(data, offsets)
        for s in range(0, len(offsets) - 1, DOCS):
            lo, hi = np.searchsorted(d, (s, s + DOCS))
            if lo == hi:
                continue
            x, y = w[lo:hi], d[lo:hi] - s
            used = np.flatnonzero(np.bincount(x, minlength=BUCKETS))
            place = np.zeros(BUCKETS, np.int64)
            place[used] = np.arange(len(used))
            n = int(y[-1]) + 1
            counts = np.bincount(y * len(used) + place[x], minlength=n * len(used)).reshape(n, -1).astype(np.float64)
            size = counts.sum(1, keepdims=True)
            rows = out[first + s : first + s + n]
            rows[:, :-1] = counts @ vectors[used].astype(np.float64) / np.maximum(size, 1)
            rows[:, -1] = size[:, 0] > 0
    return out


class Network:
    """Two layers; fit() sets the weights on some rows and the temperature on others."""

    def fit(self, x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        p = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        rate, step, size = 3e-3, 0, 128
        epochs = max(20, min(120, 400_000 // max(1, len(x))))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), size):
                i = order[s : s + size]
                h = np.tanh(x[i] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
                back = np.outer(e, p[2]) * (1 - h * h)
                grad = [x[i].T @ back + 1e-3 * p[0] / len(x) * size, back.sum(0), h.T @ e + 1e-3 * p[2] / len(x) * size, np.array([e.sum()])]
                step += 1
                lr = rate * (1 - epoch / epochs) + 1e-5
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(cy):
            z = self.logit(cx)
            loss = lambda t: float(np.mean(np.logaddexp(0, np.where(cy > 0.5, -z, z) / t)))
            self.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 200)), key=loss)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fold(key) -> F.Column:
    """0 to 4; 0 is held out. A null id is in no fold of labels."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, Network | float]:
    """Word vectors over all of docs, and the network (or, where no two labels are seen, a constant score).

    Of labels only rows whose id's crc32 is not divisible by 5 are used, at most SAMPLE of them; ids whose labels differ
    and labels other than 0 and 1 are left out. Folds 2 to 4 set the weights, fold 1 the temperature.
    """
    vectors = word_vectors(contexts(scratch, docs, text))
    seen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 0)).groupBy(key).agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
    seen = seen.where("_y = _z").orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(key).alias("_key"), F.col("_y").cast("int").alias("_y"))
    seen = scratch.table(seen, "labelled")
    # At most SAMPLE rows of two numbers.
    some = docs.join(F.broadcast(seen), F.col(key) == F.col("_key")).select(F.col("_key").cast("long").alias("id"), F.col("_y").alias("y"), fold("_key").cast("int").alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some = some.withColumn("h", F.xxhash64("id", "text"))

    def features(batches):
        for b in batches:
            x = pooled(b.column(3), vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "fold", "h", "x"])

    with arrow_rows(docs.sparkSession):
        rows = some.mapInArrow(features, "id long, y int, fold int, h long, x binary").orderBy("h", "x").limit(2 * SAMPLE).collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return vectors, float(y[0]) if len(y) else 0.5
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float)
    calibrate = np.array([r["fold"] for r in rows]) == 1
    if calibrate.all() or len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    return vectors, Network().fit(x[~calibrate], y[~calibrate], x[calibrate], y[calibrate])


def score(docs: DataFrame, model: tuple[np.ndarray, Network | float], text: str = "text", name: str = "score") -> DataFrame:
    """The columns of docs, then the score under `name`; a column of that name is replaced. Null and empty texts have the score of no words."""
    vectors, net = model
    own = [c for c in docs.columns if c.lower() != name.lower()]
    given = docs.select(*(F.col(f"`{c}`") for c in own))
    schema = given.schema.fields
    at = own.index(text)

    def run(batches):
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):  # texts go back in small batches
            x = pooled(b.column(at), vectors)
            s = net.score(x) if isinstance(net, Network) else np.full(len(x), net)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return given.mapInArrow(run, T.StructType([*schema, T.StructField(name, T.DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted (score >= 0.3).

    Null and empty texts have the score of no words, null ids are not held out; very long texts count whole. Rows that
    repeat an id are scored each. Of labelled rows that repeat an id at most 2 * SAMPLE train, those that hash least. An
    empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(Scratch(spark, "op3"), docs, labels)
    lean = docs.select("doc_id", "text")
    return score_only(lean, model).select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_only(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): as score(), without sending the texts back."""
    vectors, net = model

    def run(batches):
        for b in batches:
            x = pooled(b.column(1), vectors)
            s = net.score(x) if isinstance(net, Network) else np.full(len(x), net)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")
